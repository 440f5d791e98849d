"""Read-only scan: one issue row per missing cell, placeholder cell, outlier cell and later copy of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import without_nan
from tallyfold.functions.text import is_missing_token
from tallyfold.operators.outliers import Bounds, fit, outlier_cells
from tallyfold.operators.profile import default_key, text_columns
from tallyfold.plans.freq import row_key as keyed
from tallyfold.plans.ordering import attach
from tallyfold.plans.scale import DEFAULT, Scale

OUTLIER_THRESHOLD = 3.0
COLUMNS = ["row_key", "column", "issue_type", "description", "current_value", "severity"]


def missing_cells(df: DataFrame, row_key: str) -> DataFrame:
    table = without_nan(df)
    cells = F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns])
    found = table.select(F.col(f"`{row_key}`").alias("row_key"), F.explode(F.array_compact(cells)).alias("column"))
    return found.select(
        "row_key", "column",
        F.lit("missing").alias("issue_type"),
        F.concat(F.lit("Missing value in column "), "column").alias("description"),
        F.lit(None).cast("string").alias("current_value"),
        F.lit("error").alias("severity"),
    )


def token_cells(df: DataFrame, row_key: str) -> DataFrame:
    cells = F.array(
        *[
            F.when(
                is_missing_token(F.col(f"`{c}`")),
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("current_value")),
            )
            for c in text_columns(df)
        ]
    )
    found = df.select(F.col(f"`{row_key}`").alias("row_key"), F.inline(F.array_compact(cells)))
    text = F.concat(F.lit("Placeholder "), "current_value", F.lit(" in column "), "column", F.lit(" counts as missing"))
    return found.select(
        "row_key", "column", F.lit("missing_token").alias("issue_type"), text.alias("description"),
        "current_value", F.lit("error").alias("severity"),
    )


def outlier_issues(
    df: DataFrame,
    row_key: str,
    method: str = "auto",
    threshold: float = OUTLIER_THRESHOLD,
    bounds: list[Bounds] | None = None,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Flagged cells, with the learned bounds in ``metadata``. Severity is one per column: a broken domain
    rule anywhere in it makes all its outliers critical."""
    table = df.drop(row_key) if bounds is None else df
    learned = fit(table, method, threshold, scale=scale) if bounds is None else bounds
    if not learned:
        schema = "row_key string, column string, issue_type string, description string, current_value string, severity string"
        return df.sparkSession.createDataFrame([], schema).withColumn("metadata", F.lit(None).cast("string"))
    cells = outlier_cells(df, learned, [row_key], scale)
    critical = cells.filter("breaks_domain").select("column").distinct().withColumn("_critical", F.lit(True))
    # One row per column at most.
    marked = cells.join(F.broadcast(critical), "column", "left")
    limits = F.format_string("[%.2f – %.2f]", F.col("lower_bound"), F.col("upper_bound"))
    reason = F.when(F.col("lower_bound").isNull(), F.lit("outside its domain")).otherwise(
        F.concat(F.lit("outside the usual range "), limits)
    )
    severity = F.when(F.col("_critical"), "critical").otherwise("warning")
    return marked.select(
        F.col(f"`{row_key}`").alias("row_key"), "column",
        F.lit("outlier").alias("issue_type"),
        F.concat(F.lit("Outlier in "), "column", F.lit(": "), reason).alias("description"),
        F.col("value").cast("string").alias("current_value"),
        severity.alias("severity"),
        F.to_json(F.struct("effective_method", "column_role", "lower_bound", "upper_bound")).alias("metadata"),
    )


def duplicate_rows(df: DataFrame, row_key: str, key: list[str] | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """Every later copy of a row with the key of the first one.

    Groups are counted and reduced to their first row before anything is joined, and only groups with
    copies are joined back; a group holding a large share of the rows is joined without moving its rows. A row without a
    key is a later copy of one that has a key."""
    keys = key or [c for c in default_key(df) if c != row_key]
    table = without_nan(df)
    # Long texts are matched by their digests: neither the groups nor the join back move them.
    rows = table.select(F.col(f"`{row_key}`").alias("_row"), *keyed(table, keys))
    groups = (
        rows.groupBy(*[F.col(f"`{c}`") for c in keys])
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    matched = attach(rows, groups, keys)
    return matched.filter(~F.col("_row").eqNullSafe(F.col("_first"))).select(
        F.col("_row").alias("row_key"),
        F.lit(None).cast("string").alias("column"),
        F.lit("duplicate").alias("issue_type"),
        F.concat(F.lit("Same as row "), F.col("_first").cast("string")).alias("description"),
        F.lit(None).cast("string").alias("current_value"),
        F.lit("warning").alias("severity"),
    )


def scan(
    df: DataFrame, row_key: str, method: str = "auto", threshold: float = OUTLIER_THRESHOLD, scale: Scale = DEFAULT
) -> DataFrame:
    """All issues of a table, unordered; sort by ``row_key, column`` only what is shown."""
    parts = [
        missing_cells(df, row_key),
        token_cells(df, row_key),
        outlier_issues(df, row_key, method, threshold, scale=scale),
        duplicate_rows(df, row_key, scale=scale),
    ]
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def scan_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues"))
