"""Merging datasets on their common columns, and key-based table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import without_nan
from tallyfold.plans.ordering import null_safe


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def outer_merge(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """Full outer join on all common column names; null keys match null keys. None without common columns.

    A full outer join cannot be split when a key is hot. The tables are therefore merged as inner join plus the unmatched rows
    of either side, three equi-joins whose skewed partitions adaptive execution does split."""
    keys = common_columns(left, right)
    if not keys:
        return None
    a, b = without_nan(left), without_nan(right)
    renamed = b.select(*[F.col(f"`{c}`").alias(f"_right_{c}" if c in keys else c) for c in b.columns])
    condition = null_safe(a, renamed, [(k, f"_right_{k}") for k in keys])
    rest = [c for c in b.columns if c not in keys]
    matched = a.join(renamed, condition, "inner").select(*[F.col(f"`{c}`") for c in [*a.columns, *rest]])
    right_keys = renamed.select(*[F.col(f"`_right_{k}`") for k in keys], F.lit(True).alias("_met")).distinct()
    only_left = a.join(right_keys, null_safe(a, right_keys, [(k, f"_right_{k}") for k in keys]), "left")
    only_left = only_left.filter("_met IS NULL").select(*[F.col(f"`{c}`") for c in a.columns])
    left_keys = a.select(*[F.col(f"`{k}`").alias(f"_left_{k}") for k in keys], F.lit(True).alias("_met")).distinct()
    only_right = b.join(left_keys, null_safe(b, left_keys, [(k, f"_left_{k}") for k in keys]), "left")
    only_right = only_right.filter("_met IS NULL").select(*[F.col(f"`{c}`") for c in b.columns])
    return matched.unionByName(only_left, True).unionByName(only_right, True)


def merge_all(tables: list[tuple[str, DataFrame]], count_rows: bool = True) -> tuple[DataFrame, list[dict]]:
    """Folds ``outer_merge`` over the tables in order; a table without common columns is skipped.

    The log has one row per step. ``count_rows=False`` leaves out its row counts, which cost a job each."""
    name, result = tables[0]
    log = []
    for other_name, other in tables[1:]:
        keys = common_columns(result, other)
        step = {"step": len(log) + 1, "left": name, "right": other_name, "join_columns": keys}
        step["rows_before"] = result.count() if count_rows else None
        step["columns_before"] = len(result.columns)
        merged = outer_merge(result, other)
        step["status"] = "merged" if merged is not None else "skipped: no common columns"
        if merged is not None:
            result, name = merged, f"{name}+{other_name}"
        step["rows_after"] = result.count() if count_rows else None
        step["columns_after"] = len(result.columns)
        log.append(step)
    return result, log


def merge_log_table(df: DataFrame, log: list[dict]) -> DataFrame:
    schema = (
        "step int, left string, right string, join_columns array<string>, rows_before long, columns_before int, "
        "status string, rows_after long, columns_after int"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(step[n] for n in names) for step in log], schema)


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of all old rows with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def keep_rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def purge(tables: dict[str, tuple[DataFrame, str]], owned: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that point to an owned id. ``tables`` maps a name to the frame and its
    id column; ``owned`` has the one column ``id``."""
    out = {}
    for name, (df, column) in tables.items():
        ids = owned.select(F.col("id").alias("_id")).distinct()
        out[name] = df.join(ids, df[column] == ids["_id"], "left_anti")
    return out
