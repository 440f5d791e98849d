"""Physical plans: what is read, what moves, and what must never appear."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyfold.operators import clean, kpi, retrieval, stats, tables, tools
from tallyfold.operators.profile import distinct_counts, value_shapes

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details(df) -> str:
    """The formatted plan, whose scan lines are not shortened."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def lines(spark, small):
    return spark.read.parquet(f"{small}/lineitem.parquet")


def test_scan_prunes_and_pushes(spark, small):
    text = details(QUERIES["scan_lineitem"](spark, small))
    assert "GreaterThanOrEqual(l_shipdate" in text and "EqualTo(l_returnflag,R)" in text
    schema = text.split("ReadSchema: ")[1]
    assert "l_tax" not in schema and "l_suppkey" not in schema


def test_filter_aggregate_reads_three_columns(lines):
    query = tools.filter_aggregate(lines, F.col("l_quantity") > 10, "l_tax", "sum", ["l_returnflag"])
    text = details(query)
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in text
    assert "GreaterThan(l_quantity,10.0)" in text and plan(query).count("Exchange") == 1


@pytest.mark.parametrize("make", [
    lambda d: tables.latest_per_key(d, ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey")]),
    lambda d: clean.remove_duplicates(d, ["l_orderkey"], ["l_partkey", "l_suppkey"]),
    lambda d: retrieval.first_seen(d, F.col("l_returnflag"), "l_orderkey"),
])
def test_first_rows_are_limited_before_the_shuffle(lines, make):
    text = plan(make(lines))
    assert "WindowGroupLimit" in text and "Partial" in text.split("WindowGroupLimit")[-1]


def test_counts_combine_before_the_shuffle(lines):
    text = plan(distinct_counts(lines, ["l_returnflag", "l_linestatus"]))
    below = text.split("Exchange")[-1]
    assert "partial_count(1)" in below
    assert "partial_count" in plan(value_shapes(lines, ["l_tax", "l_quantity"]))


def test_top_groups_use_a_bounded_sort(lines):
    assert "TakeOrderedAndProject" in plan(kpi.top_by_dimension(lines, "l_tax", "l_returnflag"))


def test_correlations_scan_once(lines):
    text = plan(tools.correlations(lines, ["l_quantity", "l_tax", "l_discount"]))
    assert text.count("FileScan") == 1


def test_chi_square_makes_no_empty_cells(lines):
    text = plan(stats.contingency(lines, [("l_returnflag", "l_linestatus")]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and text.count("FileScan") == 1


def test_package_never_checkpoints_locally():
    for path in (Path(__file__).resolve().parents[1] / "tallyfold").rglob("*.py"):
        source = path.read_text()
        assert "localCheckpoint(" not in source and "crossJoin" not in source and ".rdd" not in source


def test_local_outlier_factor_reads_the_rows_once(lines):
    from tallyfold.operators.neighbours import density_flags

    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    for n in (1, 2, 3):
        flagged = density_flags(lines, {c: f"far_{c}" for c in columns[:n]})
        # The rows, and the outlying values once per column.
        assert plan(flagged).count("FileScan parquet") == 1 + n


def test_digests_stand_for_texts(spark, small):
    from tallyfold.operators import profile, scan

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for frame in (profile.duplicate_count(docs), distinct_counts(docs, ["text", "lang"]), scan.duplicate_rows(docs, "doc_id")):
        text = plan(frame)
        assert "md5" in text and "Exchange hashpartitioning" in text
