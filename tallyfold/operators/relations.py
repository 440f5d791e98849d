"""Relationship tables: merging, ranking, confidence, hierarchies."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.profile import missing_count, text_columns
from tallyfold.operators.roles import column_facts, is_identifier
from tallyfold.plans.freq import side_by_side

SCHEMA = (
    "col_a string, col_b string, type string, strength double, direction string, method string, insight string"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def merge_relationships(*sets: DataFrame, later_wins: bool = False) -> DataFrame:
    """One row per unordered column pair: from the first set that has it, or the last one."""
    order = [F.col("_set").desc() if later_wins else F.col("_set"), F.desc("strength"), F.col("col_a"), F.col("method")]
    tagged = [s.select(*NAMES).withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    pair = Window.partitionBy("_low", "_high").orderBy(*order)
    return (
        reduce(DataFrame.unionByName, tagged)
        .withColumns({"_low": F.least("col_a", "col_b"), "_high": F.greatest("col_a", "col_b")})
        .withColumn("_rn", F.row_number().over(pair))
        .filter("_rn = 1")
        .select(*NAMES)
        .orderBy(F.desc("strength"), "col_a", "col_b")
    )


def with_method(relationships: DataFrame) -> DataFrame:
    """Fills an absent method from the relationship type."""
    by_type = (
        F.when(F.col("type") == "hierarchy", "hierarchy_detector")
        .when(F.col("type") == "predictive", "custom_pps")
        .when(F.col("type") == "correlation", "pearson")
        .otherwise("unknown")
    )
    return relationships.withColumn("method", F.coalesce("method", by_type))


def strongest(relationships: DataFrame, limit: int = 6) -> DataFrame:
    return relationships.orderBy(F.desc(F.abs("strength")), "col_a", "col_b").limit(limit)


def analysis_confidence(df: DataFrame, relationships: DataFrame) -> DataFrame:
    """0.7 · mean of the five strongest + 0.3 · share of filled cells; 0.5 without relationships."""
    top = relationships.orderBy(F.desc("strength")).limit(5).agg(F.avg("strength").alias("_mean"))
    missing = sum((missing_count(df, c) for c in df.columns), F.lit(0))
    filled = df.agg((F.lit(1) - F.try_divide(missing, F.count(F.lit(1)) * len(df.columns))).alias("_filled"))
    score = F.round(F.col("_mean") * 0.7 + F.col("_filled") * 0.3, 2)
    return side_by_side(top, filled).select(F.coalesce(score, F.lit(0.5)).alias("confidence"))


def hierarchies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs of text columns where every value of the earlier one has exactly one value of the later one.

    All pairs are tested in one job: per value only the least and the greatest partner are kept, which
    combine before the shuffle."""
    if columns is None:
        facts = column_facts(df, columns=text_columns(df)) if text_columns(df) else []
        columns = [f.column for f in facts if not is_identifier(f)]
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], SCHEMA)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                F.col(f"`{a}`").cast("string").alias("a"),
                F.col(f"`{b}`").cast("string").alias("b"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    per_value = (
        df.select(F.inline(cells))
        .filter("a is not null")
        .groupBy("pair", "a")
        .agg(F.min("b").alias("low"), F.max("b").alias("high"))
    )
    holds = per_value.groupBy("pair").agg(
        F.bool_and(F.coalesce(F.col("low") == F.col("high"), F.lit(False))).alias("single"),
        F.count(F.lit(1)).alias("values"),
    )
    labels = F.create_map(
        *[x for i, (a, b) in enumerate(pairs) for x in (F.lit(i), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))]
    )
    name = labels[F.col("pair")]
    return holds.filter("single and values > 1").select(
        name["a"].alias("col_a"),
        name["b"].alias("col_b"),
        F.lit("hierarchy").alias("type"),
        F.lit(1.0).alias("strength"),
        F.concat(name["a"], F.lit(" → "), name["b"]).alias("direction"),
        F.lit("hierarchy_detector").alias("method"),
        F.concat(name["a"], F.lit(" fixes "), name["b"]).alias("insight"),
    )
