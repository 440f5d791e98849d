"""Table and column profiles: shapes, missing cells, distributions, duplicates, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.numbers import corrected_skew, is_whole, number, without_nan
from tallyfold.plans.freq import distinct_counts, long_form, modes, row_key, side_by_side, value_counts, wide_to_rows
from tallyfold.plans.quantiles import quantiles
from tallyfold.plans.scale import DEFAULT, Scale, row_count

FLAG_SUFFIX = "_outlier"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.endswith(FLAG_SUFFIX)]


def missing_count(df: DataFrame, name: str) -> Column:
    cell = F.col(f"`{name}`")
    absent = cell.isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        absent = absent | F.isnan(cell)
    return F.count_if(absent)


def _wide(df: DataFrame, columns: list[str], parts: dict) -> DataFrame:
    """One aggregate over all columns; ``parts`` maps a field to a function of (df, name)."""
    return df.agg(*[f(df, c).alias(f"{field}|{i}") for i, c in enumerate(columns) for field, f in parts.items()])


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def table_schema(df: DataFrame) -> DataFrame:
    """Names and types, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string")


def describe(df: DataFrame, columns: list[str] | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of the numeric columns."""
    columns = columns or numeric_columns(df)
    cells = {c: number(df, c) for c in columns}
    quarters = quantiles(df, cells, [0.25, 0.5, 0.75], row_count(df), scale)
    wide = _wide(
        df,
        columns,
        {
            "count": lambda d, c: F.count(cells[c]),
            "mean": lambda d, c: F.avg(cells[c]),
            "std": lambda d, c: F.stddev_samp(cells[c]),
            "min": lambda d, c: F.min(cells[c]),
            "max": lambda d, c: F.max(cells[c]),
        },
    )
    rows = wide_to_rows(
        wide, columns, {"count": "long", "mean": "double", "std": "double", "min": "double", "max": "double"}
    )
    pick = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(q) for q in quarters[c]]))])
    return rows.withColumn("_q", pick[F.col("column")]).select(
        "column", "count", "mean", "std", "min",
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max",
    )


def structural_categories(df: DataFrame) -> DataFrame:
    """numeric / datetime / boolean from the schema; text splits at half of the rows distinct."""
    fixed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            fixed[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            fixed[f.name] = "numeric"
        elif f.name in date_columns(df):
            fixed[f.name] = "datetime"
    spark = df.sparkSession
    known = spark.createDataFrame(list(fixed.items()), "column string, category string")
    open_columns = [c for c in df.columns if c not in fixed]
    if not open_columns:
        return known
    half = 0.5 * row_count(df)
    found = distinct_counts(df, open_columns).select(
        "column", F.when(F.col("distinct") < half, "categorical").otherwise("text").alias("category")
    )
    return known.unionByName(found)


def missing_by_column(df: DataFrame, keep_complete: bool = False) -> DataFrame:
    """Missing cells per column, complete columns left out."""
    wide = _wide(df, df.columns, {"missing": missing_count})
    rows = wide_to_rows(wide, df.columns, {"missing": "long"}).drop("ordinal")
    return rows if keep_complete else rows.filter("missing > 0")


def default_key(df: DataFrame) -> list[str]:
    """Columns two rows must share to be duplicates: all but a column named ``id`` and outlier flags."""
    columns = data_columns(df)
    return [c for c in columns if c != "id"] if "id" in columns and len(columns) > 1 else columns


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    table = without_nan(df)
    return (
        table.groupBy(*row_key(table, columns or default_key(df)))
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, duplicate rows, with shares in percent."""
    columns = df.columns
    totals = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        reduce(Column.__add__, [missing_count(df, c) for c in columns]).alias("missing_cells"),
    )
    cells = F.col("row_count") * F.lit(len(columns))
    return side_by_side(totals, duplicate_count(df)).select(
        "row_count",
        F.lit(len(columns)).alias("column_count"),
        "missing_cells",
        F.round(F.when(cells > 0, F.col("missing_cells") / cells * 100).otherwise(0.0), 2).alias("missing_pct"),
        "duplicate_rows",
        F.round(
            F.when(F.col("row_count") > 0, F.col("duplicate_rows") / F.col("row_count") * 100).otherwise(0.0), 2
        ).alias("duplicate_pct"),
    )


def numeric_summary(df: DataFrame, scale: Scale = DEFAULT) -> DataFrame:
    """Mean, median, deviation, extremes and missing cells per numeric column."""
    columns = [c for c in numeric_columns(df) if not c.endswith(FLAG_SUFFIX)]
    cells = {c: number(df, c) for c in columns}
    middles = quantiles(df, cells, [0.5], row_count(df), scale)
    wide = _wide(
        df,
        columns,
        {
            "mean": lambda d, c: F.avg(cells[c]),
            "std": lambda d, c: F.stddev_samp(cells[c]),
            "min": lambda d, c: F.min(cells[c]),
            "max": lambda d, c: F.max(cells[c]),
            "missing": missing_count,
        },
    )
    rows = wide_to_rows(
        wide, columns, {"mean": "double", "std": "double", "min": "double", "max": "double", "missing": "long"}
    )
    medians = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(middles[c][0]).cast("double"))])
    return rows.select("column", "mean", medians[F.col("column")].alias("median"), "std", "min", "max", "missing")


def categorical_summary(df: DataFrame) -> DataFrame:
    """Distinct values, commonest value (smallest on ties) and missing cells per text column."""
    columns = text_columns(df)
    missing = wide_to_rows(_wide(df, columns, {"missing": missing_count}), columns, {"missing": "long"})
    found = modes(df, columns).select(
        "column", F.col("distinct").alias("unique"), F.col("mode").alias("most_common"), "mode_count"
    )
    return missing.drop("ordinal").join(found, "column", "left").fillna(0, ["unique", "mode_count"])


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing, distinct, flagged outliers and completeness; shares in percent."""
    columns = data_columns(df)
    flagged = {c: f"{c}{FLAG_SUFFIX}" for c in columns if f"{c}{FLAG_SUFFIX}" in df.columns}
    wide = _wide(
        df,
        columns,
        {
            "rows": lambda d, c: F.count(F.lit(1)),
            "missing": missing_count,
            "outlier_count": lambda d, c: F.count_if(F.col(f"`{flagged[c]}`").cast("boolean"))
            if c in flagged
            else F.max(F.lit(0)),
        },
    )
    rows = wide_to_rows(wide, columns, {"rows": "long", "missing": "long", "outlier_count": "long"})
    types = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    share = lambda part: F.round(F.when(F.col("rows") > 0, part / F.col("rows") * 100).otherwise(0.0), 2)
    return (
        rows.join(distinct_counts(df, columns), "column", "left")
        .fillna(0, ["distinct"])
        .select(
            "ordinal",
            "column",
            types[F.col("column")].alias("dtype"),
            "missing",
            share(F.col("missing")).alias("missing_pct"),
            F.col("distinct").alias("unique"),
            share(F.col("distinct")).alias("unique_pct"),
            "outlier_count",
            F.round(F.lit(100.0) - share(F.col("missing")), 2).alias("completeness"),
        )
    )


def quality_score(report: DataFrame, outlier_pct: Column, valid: Column, warnings: Column) -> DataFrame:
    """0-100 score of a ``quality_report`` row, lowered by missing, duplicate and outlier shares and by validation."""
    penalty = F.least(
        F.lit(20.0), F.when(valid, 0.0).otherwise(15.0) + F.least(warnings * F.lit(2.0), F.lit(5.0))
    )
    capped = lambda c: F.least(c, F.lit(100.0))
    score = (
        F.lit(100.0)
        - F.lit(0.40) * capped(F.col("missing_pct"))
        - F.lit(0.20) * capped(F.col("duplicate_pct"))
        - F.lit(0.20) * capped(outlier_pct)
        - penalty
    )
    return report.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 2))


def value_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value shape per numeric column. Grouping the long form keeps the generated code small however many
    columns there are, and partial aggregates leave one row per column and task to shuffle."""
    value = F.col("value")
    share = lambda condition: F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))
    return (
        long_form(df, columns, "double")
        .groupBy("column")
        .agg(
            F.count(value).alias("n"),
            share(is_whole(value)).alias("integer_rate"),
            share(value >= 0).alias("non_negative_rate"),
            share(value > 0).alias("positive_rate"),
            corrected_skew(value, F.count(value)).alias("skew"),
            share(value.between(0, 100)).alias("percentage_0_100_rate"),
            F.var_samp(value).alias("variance"),
            F.coalesce(F.bool_and(value.isin(0.0, 1.0)), F.lit(False)).alias("zero_one"),
        )
    )


def with_count_like_score(shapes: DataFrame) -> DataFrame:
    """Adds the share of distinct values and how much the column looks like counts."""
    some = F.col("n") > 0
    repeated = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("unique_ratio")))
    score = (
        F.lit(0.45) * F.col("integer_rate") + F.lit(0.35) * F.col("non_negative_rate") + F.lit(0.20) * repeated
    )
    return shapes.withColumn("unique_ratio", F.when(some, F.col("distinct") / F.col("n")).otherwise(0.0)).withColumn(
        "count_like_score", F.when(some, score).otherwise(0.0)
    )


def value_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shape of each numeric column's values; one scan, plus exact distinct counts."""
    columns = columns or numeric_columns(df)
    counted = value_shapes(df, columns).join(distinct_counts(df, columns), "column", "left").fillna(0, ["distinct"])
    return with_count_like_score(counted).drop("largest")


def key_candidates(df: DataFrame) -> DataFrame:
    """Primary keys (unique, complete) and likely foreign keys (10-90 % distinct)."""
    wide = _wide(df, df.columns, {"rows": lambda d, c: F.count(F.lit(1)), "missing": missing_count})
    rows = wide_to_rows(wide, df.columns, {"rows": "long", "missing": "long"})
    ratio = F.col("distinct") / F.col("rows")
    kind = F.when((F.col("distinct") == F.col("rows")) & (F.col("missing") == 0), "primary_key").when(
        (ratio > 0.1) & (ratio < 0.9), "foreign_key"
    )
    return (
        rows.join(distinct_counts(df), "column")
        .withColumn("key_type", kind)
        .filter("key_type is not null")
        .select(
            "column",
            "key_type",
            F.when(F.col("key_type") == "primary_key", 1.0).otherwise(0.7).alias("confidence"),
            F.when(
                F.col("key_type") == "primary_key",
                F.concat("column", F.lit(": every row has its own value")),
            )
            .otherwise(F.concat("column", F.lit(": values repeat as references do")))
            .alias("insight"),
        )
    )


def sample_values(df: DataFrame, max_columns: int | None = None, max_values: int = 15) -> DataFrame:
    """Up to 15 values, in value order, of each text column with 2-50 distinct values."""
    columns = [c for c in df.columns[:max_columns] if c in text_columns(df)]
    counts = value_counts(df, columns)
    low = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).filter("distinct between 2 and 50")
    ordered = Window.partitionBy("column").orderBy("value")
    return (
        counts.join(F.broadcast(low), "column", "left_semi")
        .withColumn("position", F.row_number().over(ordered))
        .filter(F.col("position") <= max_values)
        .select("column", "position", "value")
    )
