"""Typed table questions: filter + aggregate, counts, description, correlation, SQL expressions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.operators.charts import value_counts_chart
from tallyfold.operators.kpi import group_values
from tallyfold.operators.profile import describe, numeric_columns
from tallyfold.plans.scale import DEFAULT, Scale

# Sizes of results that are shown to people.
SERIES_ROWS = 50
FRAME_ROWS = 20
PREVIEW_CHARS = 500

# Correlations per aggregate: more would make its generated code too large to be compiled.
PAIRS_PER_PASS = 300


def filter_aggregate(
    df: DataFrame,
    where: Column | str | None,
    column: str,
    how: str = "sum",
    group_by: list[str] | None = None,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Aggregate over the rows that pass a predicate, per group or in total."""
    kept = df.filter(where) if where is not None else df
    if group_by:
        return group_values(kept, group_by, column, how, scale=scale)
    return group_values(kept.withColumn("_all", F.lit(1)), ["_all"], column, how, scale=scale).drop("_all")


def count_values(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    return value_counts_chart(df, column, most)


def describe_columns(df: DataFrame, columns: list[str] | None = None, scale: Scale = DEFAULT) -> DataFrame:
    return describe(df, columns, scale)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(x, y, r)``; every pair uses the rows where both are present.

    A few hundred pairs share one aggregate over one scan; the mirror half is added afterwards."""
    columns = columns or numeric_columns(df)
    cells = {c: number(df, c) for c in columns}
    measures = [(a, b, F.corr(cells[a], cells[b])) for a, b in combinations(columns, 2)]
    measures += [(c, c, F.when(F.var_pop(cells[c]) > 0, F.lit(1.0))) for c in columns]
    row = lambda a, b, name: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(name).alias("r"))
    parts = []
    for start in range(0, len(measures), PAIRS_PER_PASS):
        batch = measures[start : start + PAIRS_PER_PASS]
        wide = df.agg(*[m.alias(f"r{i}") for i, (_, _, m) in enumerate(batch)])
        rows = [row(x, y, f"r{i}") for i, (a, b, _) in enumerate(batch) for x, y in dict.fromkeys([(a, b), (b, a)])]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def evaluate(df: DataFrame, expressions: dict[str, str], where: str | None = None) -> DataFrame:
    """User expressions as Spark SQL text, checked and planned by Spark itself."""
    kept = df.filter(where) if where else df
    return kept.select(*[F.expr(text).alias(name) for name, text in expressions.items()])


def evaluate_aggregates(df: DataFrame, expressions: dict[str, str], group_by: list[str] | None = None) -> DataFrame:
    out = [F.expr(text).alias(name) for name, text in expressions.items()]
    return df.groupBy(*group_by).agg(*out) if group_by else df.agg(*out)


def bounded(df: DataFrame, order_by: list[Column | str], series: bool = False) -> DataFrame:
    """The rows a person gets to see: 50 of a series, 20 of a frame, long texts shortened."""
    shown = df.orderBy(*order_by).limit(SERIES_ROWS if series else FRAME_ROWS)
    texts = {c: F.left(F.col(f"`{c}`"), F.lit(PREVIEW_CHARS)) for c, t in df.dtypes if t == "string"}
    return shown.withColumns(texts)
