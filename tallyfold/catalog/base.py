"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), d) + F.lit(0.0) for c, d in digits.items()})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Damaged orders: the same arithmetic on the key in Spark and in the checking SQL, because the checker only
# sees the original tables. Nulls, placeholders, flipped signs, a hundredfold, copies, copies in other case.
DAMAGED = {
    "row_id": "o_orderkey",
    "customer": "o_custkey",
    "status": (
        "CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 100 = 11 THEN 'NA' "
        "WHEN o_orderkey % 100 = 12 THEN '' WHEN o_orderkey % 100 = 13 THEN ' n/a ' "
        "WHEN o_orderkey % 100 = 14 THEN '-' WHEN o_orderkey % 100 = 15 THEN '?' "
        "WHEN o_orderkey % 10 = 4 THEN concat('  ', lower(o_orderstatus), ' ') ELSE o_orderstatus END"
    ),
    "amount": (
        "CASE WHEN o_orderkey % 50 = 9 THEN NULL WHEN o_orderkey % 100 = 21 THEN -o_totalprice "
        "WHEN o_orderkey % 200 = 33 THEN o_totalprice * 100 ELSE o_totalprice END"
    ),
    "priority": (
        "CASE WHEN o_orderkey % 50 = 3 THEN NULL "
        "WHEN o_orderkey % 10 = 6 THEN concat(' ', replace(o_orderpriority, '-', ' -   ')) ELSE o_orderpriority END"
    ),
    "placed": "o_orderdate",
}
_COPIES = {**DAMAGED, "row_id": "o_orderkey + 10000000"}
_VARIANTS = {
    **DAMAGED,
    "row_id": "o_orderkey + 20000000",
    "priority": "CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE concat(lower(o_orderpriority), '  ') END",
}


def _select(columns: dict[str, str], where: str | None = None) -> str:
    text = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM orders"
    return text + (f" WHERE {where}" if where else "")


DAMAGED_SQL = " UNION ALL ".join(
    [
        _select(DAMAGED),
        _select(_COPIES, "o_orderkey % 100 = 50"),
        _select(_VARIANTS, "o_orderkey % 100 = 60"),
    ]
)


def damaged_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    pick = lambda columns: [f"{e} AS {n}" for n, e in columns.items()]
    return (
        orders.selectExpr(*pick(DAMAGED))
        .unionByName(orders.filter("o_orderkey % 100 = 50").selectExpr(*pick(_COPIES)))
        .unionByName(orders.filter("o_orderkey % 100 = 60").selectExpr(*pick(_VARIANTS)))
    )
