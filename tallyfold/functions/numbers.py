"""Number parsing, rounding and display as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text accepted as a number. A plain try_cast would also take '12d'.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def text_to_number(column: Column) -> Column:
    """Text to double; anything that is not fully a number becomes null."""
    return F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as a nullable double, without NaN, whatever its stored type is."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(F.col(f"`{name}`").cast("double"))
    if isinstance(kind, T.StringType):
        return text_to_number(F.col(f"`{name}`"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(f"`{name}`").cast("double")
    return F.lit(None).cast("double")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and null are one kind of missing: every floating column gets null for NaN."""
    return df.select(
        *[
            nan_to_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def is_whole(column: Column) -> Column:
    """True when the value equals its nearest integer within 1e-8 + 1e-5 of its size."""
    nearest = F.rint(column)
    return F.abs(column - nearest) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(nearest)


def short_number(column: Column) -> Column:
    """1234567 as 1.23M, 1234 as 1.23K, smaller with two decimals, null as N/A."""
    value = column.cast("double")
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("N/A"))
        .when(size >= 1_000_000, F.format_string("%.2fM", value / F.lit(1_000_000.0)))
        .when(size >= 1_000, F.format_string("%.2fK", value / F.lit(1_000.0)))
        .otherwise(F.format_string("%.2f", value))
    )


def fact_number(column: Column) -> Column:
    """Number text of the fact lines: thousands grouped, else at most two decimals."""
    value = F.round(column.cast("double"), 4)
    small = F.format_string("%.2f", value)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("n/a"))
        .when((F.abs(value) >= 1000) & (value == F.rint(value)), F.format_string("%,.0f", value))
        .when(F.abs(value) >= 1000, F.format_string("%,.2f", value))
        .otherwise(F.regexp_replace(F.regexp_replace(small, "0+$", ""), r"\.$", ""))
    )


def corrected_skew(column: Column, count: Column) -> Column:
    """Sample skewness; Spark's own is the population form. 0 below three values."""
    n = count.cast("double")
    return F.when(n < 3, F.lit(0.0)).otherwise(
        F.coalesce(F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))
    )
