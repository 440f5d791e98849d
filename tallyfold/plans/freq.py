"""Value/count tables of many columns in one pass, kept in the columns' own types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.numbers import nan_to_null


#: Bytes up to which a text is its own key; a longer one is stood for by a digest of 128 bits.
KEY_BYTES = 32


def text_key(value: Column) -> Column:
    """A key of bounded size that equal texts share, so that whole texts are never shuffled to be counted or matched."""
    return F.when(F.octet_length(value) > KEY_BYTES, F.concat(F.lit("\0"), F.md5(value.cast("binary")))).otherwise(value)


def row_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as grouping keys under their own names, texts and binary values by their keys."""
    out = []
    for c in columns:
        cell = F.col(f"`{c}`")
        kind = df.schema[c].dataType
        if isinstance(kind, T.BinaryType):
            cell = F.base64(cell)
        out.append((text_key(cell) if isinstance(kind, (T.StringType, T.BinaryType)) else cell).alias(c))
    return out


def family(kind: T.DataType) -> str:
    """Columns of one family share a value type in an unpivoted table."""
    if isinstance(kind, T.IntegralType):
        return "whole"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "fraction"
    # Texts, and dates and booleans by their text.
    return "text"


_CAST = {"whole": "long", "fraction": "double", "text": "string"}


def families(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in columns or df.columns:
        out.setdefault(family(df.schema[name].dataType), []).append(name)
    return out


def long_form(df: DataFrame, columns: list[str], cast: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(keep…, column, value)`` with one row per cell, by the generated-code row expansion."""
    kept = keep or {}
    cells = df.select(*[c.alias(n) for n, c in kept.items()], *[_cell(df, c, cast).alias(c) for c in columns])
    return cells.unpivot([F.col(n) for n in kept], [F.col(f"`{c}`") for c in columns], "column", "value")


def _cell(df: DataFrame, name: str, cast: str) -> Column:
    cell = F.col(f"`{name}`").cast(cast)
    return nan_to_null(cell) if isinstance(df.schema[name].dataType, T.FractionalType) else cell


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` of columns of one family, nulls left out; partial counts before the shuffle."""
    cast = _CAST[family(df.schema[columns[0]].dataType)]
    return (
        long_form(df, columns, cast)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, distinct, largest)``: distinct values and the count of the commonest one."""
    parts = []
    for kind, group in families(df, columns).items():
        cells = long_form(df, group, _CAST[kind]).filter(F.col("value").isNotNull())
        key = text_key(F.col("value")) if kind == "text" else F.col("value")
        counts = cells.select("column", key.alias("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("largest")))
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, distinct, mode, mode_count)`` as text; ties go to the smallest value."""
    parts = [
        value_counts(df, group)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.min_by("value", F.struct((-F.col("n")).alias("r"), F.col("value"))).cast("string").alias("mode"),
            F.max("n").alias("mode_count"),
        )
        for group in families(df, columns).values()
    ]
    return reduce(DataFrame.unionByName, parts)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames of different columns as one row, by a union and a maximum instead of a keyless join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in stacked.columns])


def wide_to_rows(wide: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turns a one-row aggregate with names ``<field>|<i>`` into one row per column.

    ``fields`` maps each output field to its type.
    """
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column"),
            *[F.col(f"`{f}|{i}`").cast(t).alias(f) for f, t in fields.items()],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))
