"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tests.compare import compare, database  # noqa: E402

QUERIES, CHECKS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return database(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, small, name):
    result = compare(spark, connection, small, QUERIES[name], CHECKS.get(name))
    assert result["ok"], result["problem"]


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 10
