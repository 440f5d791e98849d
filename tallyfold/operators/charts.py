"""Chart data as tidy frames; arrays are built only by whoever draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.operators.kpi import aggregate, aggregate_name, group_values
from tallyfold.operators.profile import numeric_columns
from tallyfold.plans.quantiles import quantiles
from tallyfold.plans.scale import DEFAULT, Scale


def group_chart(
    df: DataFrame,
    x: str,
    y: str,
    how: str = "sum",
    order: str = "key",
    limit: int | None = None,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """One point per group, ordered by key; ``order='value'`` and ``limit`` are there for top charts."""
    points = group_values(df, [x], y, how, "y", scale).select(F.col(f"`{x}`").alias("x"), "y")
    ordered = points.orderBy("x") if order == "key" else points.orderBy(F.desc("y"), "x")
    return ordered.limit(limit) if limit else ordered


MAX_LABELS = 10_000


def crosstab(df: DataFrame, row: str, column: str, normalize: bool = False) -> DataFrame:
    """Long crosstab ``(row, column, value)`` of all label combinations, zero-filled.

    The dense table is a pivot of the counted pairs, so only counts are widened, never rows."""
    pairs = df.select(F.col(f"`{row}`").cast("string").alias("row"), F.col(f"`{column}`").cast("string").alias("col"))
    counts = pairs.dropna().groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    labels = sorted(r["col"] for r in counts.select("col").distinct().limit(MAX_LABELS + 1).collect())
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{column} has more than {MAX_LABELS} labels: too wide for a dense crosstab")
    if not labels:
        return counts.select("row", F.col("col").alias("column"), F.col("n").alias("value"))
    filled = counts.groupBy("row").pivot("col", labels).agg(F.first("n")).fillna(0)
    long = filled.unpivot(["row"], [F.col(f"`{c}`") for c in labels], "column", "value")
    if not normalize:
        return long
    total = F.sum("value").over(Window.partitionBy("row"))
    return long.withColumn("value", F.col("value") / total)


def value_counts_chart(df: DataFrame, column: str, top_n: int | None = 20) -> DataFrame:
    """Commonest values, nulls left out."""
    counted = df.select(F.col(f"`{column}`").alias("x")).dropna().groupBy("x").agg(F.count(F.lit(1)).alias("y"))
    ordered = counted.orderBy(F.desc("y"), "x")
    return ordered if top_n is None else ordered.limit(top_n)


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points where both cells are numbers."""
    return df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()


def metric_summary(df: DataFrame, metrics: list[str], how: str = "sum", scale: Scale = DEFAULT) -> DataFrame:
    """One aggregate per metric; metrics without any value are dropped."""
    if aggregate_name(how) == "median":
        found = quantiles(df, {m: number(df, m) for m in metrics}, [0.5], scale=scale)
        rows = [(m, v[0]) for m, v in found.items() if v[0] is not None]
        return df.sparkSession.createDataFrame(rows, "x string, y double")
    wide = df.agg(
        *[F.when(F.count(number(df, m)) > 0, aggregate(df, m, how)).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)]
    )
    rows = F.array(*[F.struct(F.lit(m).alias("x"), F.col(f"m{i}").alias("y")) for i, m in enumerate(metrics)])
    return wide.select(F.inline(rows)).filter("y is not null")


def multi_series(df: DataFrame, x: str | None = None, series: list[str] | None = None) -> DataFrame:
    """Wide result to ``(x, series, value)``; nulls become 0."""
    x = x or df.columns[0]
    series = series or [c for c in numeric_columns(df) if c != x]
    named = df.select(
        F.col(f"`{x}`").alias("x"), *[F.coalesce(number(df, c), F.lit(0.0)).alias(c) for c in series]
    )
    return named.unpivot(["x"], [F.col(f"`{c}`") for c in series], "series", "value")


def top_points(points: DataFrame, label: str, value: str, n: int = 3) -> DataFrame:
    """Strongest points of a chart; a series counts once, with its maximum."""
    best = points.dropna(subset=[value]).groupBy(F.col(f"`{label}`").alias("label")).agg(F.max(value).alias("value"))
    return best.orderBy(F.desc("value"), "label").limit(n)


def run_charts(df: DataFrame, specs: list[dict]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Lazy frames by title, and messages of the specs that cannot be planned.

    A spec is a dict with ``title``, ``chart`` (group, crosstab, value_counts, scatter, summary) and the
    arguments of that chart."""
    makers = {
        "group": group_chart,
        "crosstab": crosstab,
        "value_counts": value_counts_chart,
        "scatter": scatter,
        "summary": metric_summary,
    }
    charts, errors = {}, {}
    for number_, spec in enumerate(specs):
        title = spec.get("title", f"chart {number_ + 1}")
        args = {k: v for k, v in spec.items() if k not in ("title", "chart")}
        try:
            named = [v for k, v in args.items() if k in ("x", "y", "row", "column")] + args.get("metrics", [])
            absent = [c for c in named if c not in df.columns]
            if absent or spec.get("chart") not in makers:
                raise ValueError(f"no column {', '.join(absent)}" if absent else f"no chart {spec.get('chart')}")
            charts[title] = makers[spec["chart"]](df, **args)
        except (ValueError, TypeError) as error:
            errors[title] = str(error)
    return charts, errors


def union_charts(charts: dict[str, DataFrame]) -> DataFrame:
    """Charts of ``(x, y)`` stacked with their title."""
    parts = [
        c.select(F.lit(t).alias("title"), F.col("x").cast("string").alias("x"), F.col("y").cast("double").alias("y"))
        for t, c in charts.items()
    ]
    return reduce(DataFrame.unionByName, parts)
