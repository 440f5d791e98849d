"""Key figures: scalar aggregates, group arg-max, monthly trend, top values, batches of typed specs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.dates import month_text, parse_date
from tallyfold.functions.numbers import number, short_number
from tallyfold.plans.quantiles import group_quantile, quantiles
from tallyfold.plans.scale import DEFAULT, Scale, row_count

# Aggregate names of the typed specs.
AGGREGATES = ("sum", "mean", "median", "min", "max", "count", "std", "var", "nunique")
ALIASES = {"avg": "mean", "average": "mean", "distinct": "nunique", "variance": "var"}


def aggregate_name(name: str) -> str:
    found = ALIASES.get(name.lower(), name.lower())
    if found not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}; use one of {', '.join(AGGREGATES)}")
    return found


def cell(df: DataFrame, column: str) -> Column:
    """The stored value, NaN being a missing one."""
    raw = F.col(f"`{column}`")
    return F.when(~F.isnan(raw), raw) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else raw


def aggregate(df: DataFrame, column: str, how: str) -> Column:
    """The aggregate as an expression; sums of no values are 0, as in the report figures."""
    how = aggregate_name(how)
    value = number(df, column)
    if how == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if how in ("count", "nunique"):
        raw = cell(df, column)
        return F.count(raw) if how == "count" else F.count_distinct(raw)
    if how == "median":
        raise ValueError("median is planned by the caller")
    return {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}[how](value)


def scalar_kpis(df: DataFrame, column: str, aggregates: list[str] | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """All wanted scalar figures of one column, as one row, in one aggregate."""
    wanted = [aggregate_name(a) for a in (aggregates or AGGREGATES)]
    value = number(df, column)
    out = []
    for how in wanted:
        if how == "median":
            middle = quantiles(df, {"v": value}, [0.5], row_count(df), scale)["v"][0]
            out.append(F.max(F.lit(middle).cast("double")).alias("median"))
        elif how == "count":
            out.append(F.count(value).alias("count"))
        elif how == "nunique":
            out.append(F.count_distinct(value).alias("nunique"))
        else:
            out.append(aggregate(df, column, how).cast("double").alias(how))
    return df.agg(*out)


def row_count_kpi(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def mode_kpi(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value and its count; the smallest value wins ties, nulls are left out."""
    counted = df.select(cell(df, column).alias("value")).filter("value IS NOT NULL").groupBy("value").count()
    return counted.orderBy(F.desc("count"), "value").limit(1).select("value", F.col("count").alias("n"))


def group_values(
    df: DataFrame, keys: list[str], column: str, how: str, output: str = "value", scale: Scale = DEFAULT
) -> DataFrame:
    """One aggregate per group; rows with a null key are dropped."""
    how = aggregate_name(how)
    kept = df.dropna(subset=keys)
    if how == "median":
        return group_quantile(kept, keys, number(df, column), 0.5, output, row_count(df), scale)
    return kept.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(aggregate(df, column, how).alias(output))


def group_argmax(df: DataFrame, key: str, column: str, how: str = "sum", scale: Scale = DEFAULT) -> DataFrame:
    """Label with the largest aggregate; the smallest label wins ties."""
    grouped = group_values(df, [key], column, how, scale=scale).filter("value is not null")
    return grouped.orderBy(F.desc("value"), f"`{key}`").limit(1).select(F.col(f"`{key}`").alias("label"), "value")


def kpi_block(df: DataFrame, metric: str) -> DataFrame:
    """Total, average and row count of the primary metric."""
    value = number(df, metric)
    return df.agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.avg(value).alias("average"),
        F.count(F.lit(1)).alias("row_count"),
    )


def timestamps(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return parse_date(F.col(f"`{column}`")) if isinstance(kind, T.StringType) else F.col(f"`{column}`")


def first_usable_time(df: DataFrame, candidates: list[str], min_rate: float = 0.7) -> str | None:
    """First candidate whose cells parse as dates often enough; stored dates count their non-nulls."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.avg(timestamps(df, c).isNotNull().cast("int")).alias(f"r{i}") for i, c in enumerate(present)])
    rates = row.first()
    return next((c for i, c in enumerate(present) if (rates[f"r{i}"] or 0) >= min_rate), None)


def monthly_trend(df: DataFrame, metric: str, time_columns: list[str]) -> DataFrame:
    """Sum of the metric per month, in month order."""
    time = first_usable_time(df, time_columns)
    if time is None:
        return df.sparkSession.createDataFrame([], "period string, value double")
    rows = df.select(month_text(timestamps(df, time)).alias("period"), number(df, metric).alias("value")).dropna()
    return rows.groupBy("period").agg(F.sum("value").alias("value")).orderBy("period")


def top_by_dimension(df: DataFrame, metric: str, dimension: str, top_n: int = 10) -> DataFrame:
    """Groups with the largest totals; a bounded sort, never a full one."""
    rows = df.select(F.col(f"`{dimension}`").cast("string").alias("key"), number(df, metric).alias("value")).dropna()
    return rows.groupBy("key").agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "key").limit(top_n)


@dataclass(frozen=True)
class Kpi:
    """Typed figure: ``sum``/``mean``/… of a column, ``row_count``, ``mode``, or arg-max over a group."""

    name: str
    kind: str
    column: str | None = None
    group: str | None = None


def run_kpis(df: DataFrame, specs: list[Kpi], scale: Scale = DEFAULT) -> tuple[DataFrame, dict[str, str]]:
    """All figures as rows ``(kpi_name, value, label)`` plus the specs that could not be planned.

    Scalar figures of one table share a single aggregate; a faulty spec never spoils the others."""
    errors: dict[str, str] = {}
    scalars: list[tuple[str, Column]] = []
    frames: list[DataFrame] = []
    medians = {}
    for spec in specs:
        try:
            if spec.column is not None and spec.column not in df.columns:
                raise ValueError(f"no column {spec.column}")
            if spec.group is not None:
                if spec.group not in df.columns:
                    raise ValueError(f"no column {spec.group}")
                best = group_argmax(df, spec.group, spec.column, spec.kind, scale)
                frames.append(_kpi_row(best, spec.name, F.col("value"), F.col("label")))
            elif spec.kind == "mode":
                frames.append(_kpi_row(mode_kpi(df, spec.column), spec.name, F.col("n"), F.col("value")))
            elif spec.kind == "row_count":
                scalars.append((spec.name, F.count(F.lit(1))))
            elif aggregate_name(spec.kind) == "median":
                medians[spec.name] = number(df, spec.column)
            else:
                scalars.append((spec.name, aggregate(df, spec.column, spec.kind)))
        except ValueError as error:
            errors[spec.name] = str(error)
    for name, value in quantiles(df, medians, [0.5], scale=scale).items():
        scalars.append((name, F.max(F.lit(value[0]).cast("double"))))
    if scalars:
        wide = df.agg(*[c.cast("double").alias(f"s{i}") for i, (_, c) in enumerate(scalars)])
        rows = F.array(
            *[
                F.struct(
                    F.lit(n).alias("kpi_name"), F.col(f"s{i}").alias("value"), F.lit(None).cast("string").alias("label")
                )
                for i, (n, _) in enumerate(scalars)
            ]
        )
        frames.insert(0, wide.select(F.inline(rows)))
    if not frames:
        return df.sparkSession.createDataFrame([], "kpi_name string, value double, label string"), errors
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result, errors


def _kpi_row(df: DataFrame, name: str, value: Column, label: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("kpi_name"), value.cast("double").alias("value"), label.cast("string").alias("label")
    )


def formatted(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds the display text of a figure."""
    return df.withColumn("formatted", short_number(F.col(f"`{column}`")))
