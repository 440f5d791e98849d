"""Validation of a table against structure rules and value rules."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.operators.profile import _wide, missing_count
from tallyfold.plans import names as N
from tallyfold.plans.freq import distinct_counts, wide_to_rows


def missing_findings(df: DataFrame) -> DataFrame:
    """Columns without any value, and columns more than half missing."""
    wide = _wide(df, df.columns, {"rows": lambda d, c: F.count(F.lit(1)), "missing": missing_count})
    rows = wide_to_rows(wide, df.columns, {"rows": "long", "missing": "long"})
    share = F.col("missing") / F.col("rows") * 100
    return rows.filter((F.col("rows") > 0) & (share > 50)).select(
        "column",
        F.when(F.col("missing") == F.col("rows"), "all_missing").otherwise("high_missing").alias("finding"),
        F.round(share, 1).alias("missing_pct"),
    )


def single_value_columns(df: DataFrame) -> DataFrame:
    return distinct_counts(df).filter("distinct = 1").select("column")


def range_violations(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their allowed range, counted per column in one scan."""
    columns = [c for c in ranges if c in df.columns]
    parts = []
    for i, c in enumerate(columns):
        low, high = ranges[c]
        value = number(df, c)
        broken = F.lit(False)
        if low is not None:
            broken = broken | (value < low)
        if high is not None:
            broken = broken | (value > high)
        parts.append(F.count_if(broken).alias(f"violations|{i}"))
    return wide_to_rows(df.agg(*parts), columns, {"violations": "long"}).drop("ordinal")


def structure_errors(
    df: DataFrame,
    required_columns: list[str] | None = None,
    min_rows: int | None = None,
    column_types: dict[str, str] | None = None,
) -> list[str]:
    """Faults visible from the schema, emptiness and row count."""
    errors = []
    repeated = sorted(n for n, k in Counter(c.lower() for c in df.columns).items() if k > 1)
    if repeated:
        errors.append(f"Duplicate column names: {repeated}")
    if df.isEmpty():
        errors.append("Table is empty")
    absent = sorted(set(required_columns or []) - set(df.columns))
    if absent:
        errors.append(f"Missing required columns: {absent}")
    if min_rows is not None:
        rows = df.limit(min_rows).count()
        if rows < min_rows:
            errors.append(f"Too few rows: {rows} (at least {min_rows} wanted)")
    for name, kind in (column_types or {}).items():
        found = dict(df.dtypes).get(name)
        if found is not None and found != kind:
            errors.append(f"Column {name} is {found}, not {kind}")
    return errors


def validate(df: DataFrame, rules: dict | None = None) -> dict:
    """Report with ``valid``, ``errors`` and ``warnings``. ``rules`` may hold required_columns, min_rows,
    column_types and value_ranges."""
    rules = rules or {}
    known = {k: rules[k] for k in ("required_columns", "min_rows", "column_types") if k in rules}
    errors = structure_errors(df, **known)
    warnings = []
    if "Table is empty" not in errors:
        for row in missing_findings(df).collect():
            text = "has no values" if row["finding"] == "all_missing" else f"is {row['missing_pct']}% missing"
            warnings.append(f"{row['column']} {text}")
        warnings += [f"{r['column']} has a single value" for r in single_value_columns(df).collect()]
        if rules.get("value_ranges"):
            for row in range_violations(df, rules["value_ranges"]).filter("violations > 0").collect():
                warnings.append(f"{row['column']}: {row['violations']} values out of range")
    return {"valid": not errors, "errors": errors, "warnings": warnings}


def _match_report(df: DataFrame, matches) -> DataFrame:
    return df.agg(
        F.count_if(matches).alias("valid"),
        (F.count(F.lit(1)) - F.count_if(matches)).alias("invalid"),
        F.round(F.try_divide(F.count_if(matches), F.count(F.lit(1))) * 100, 2).alias("validity_rate"),
    )


def email_validity(df: DataFrame, column: str) -> DataFrame:
    return _match_report(df, F.coalesce(F.col(f"`{column}`").rlike(N.EMAIL_TEXT), F.lit(False)))


def phone_validity(df: DataFrame, column: str) -> DataFrame:
    """Everything but digits and plus is dropped before the test."""
    digits = F.regexp_replace(F.col(f"`{column}`"), "[^0-9+]", "")
    return _match_report(df, F.coalesce(digits.rlike(N.PHONE_TEXT), F.lit(False)))
