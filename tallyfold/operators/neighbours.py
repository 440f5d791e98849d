"""Local outlier factor of columns, each by itself, in one pass over all of them.

In one dimension the k nearest values of a row lie among the k rows on either side in value order. Equal
values are counted first: more than k + 1 copies of a value change no factor, so no value travels more
often than that and hot values cost nothing. The remaining rows get a position, positions form fixed-size
blocks, and each block also receives the 3k rows next to it, which is all that k-distance, reachability
and the factor need. Every block is scored in its own Arrow group; no block grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.plans.ordering import BLOCK, HALO, POSITION, running_sum, with_blocks
from tallyfold.plans.scale import DEFAULT, Scale
from tallyfold.session import stored

MAX_NEIGHBOURS = 20
THRESHOLD = 1.5
BLOCK_ROWS = 50_000


def density_outliers(
    df: DataFrame, column: str, output: str, block_rows: int = BLOCK_ROWS, scale: Scale = DEFAULT
) -> DataFrame:
    """Adds boolean ``output``; null cells are never outliers."""
    return density_flags(df, {column: output}, block_rows, scale)


def density_flags(
    df: DataFrame, outputs: dict[str, str], block_rows: int = BLOCK_ROWS, scale: Scale = DEFAULT
) -> DataFrame:
    """Adds a boolean column for each key of ``outputs``; null cells are never outliers.

    The values of all columns are counted, placed and scored together, by column; what is left are the outlying values, a table that
    is stored once and met by the rows column by column, so the rows themselves are read once."""
    columns = list(outputs)
    cells = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = cells.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    nearest = F.array(*[F.lit(min(MAX_NEIGHBOURS, max(2, sizes[f"c{i}"] - 1))) for i in range(len(columns))])
    spread = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("value")) for i in range(len(columns))])
    counted = cells.select(F.inline(spread)).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.withColumn("_k", F.get(nearest, F.col("column"))).withColumn("_copies", F.least(F.col("n"), F.col("_k") + 1))
    placed = running_sum(copies, ["column"], ["value"], F.col("_copies"), max(sizes), "_first", scale).select(
        "column", "value", "_k", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(POSITION)
    )
    reach = 3 * MAX_NEIGHBOURS
    blocks = with_blocks(placed, block_rows, before=reach, after=reach)

    def score(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(POSITION, kind="stable")
        own = ~block[HALO].to_numpy(bool)
        x = block["value"].to_numpy("float64")
        factor = local_factor(x, int(block["_k"].iloc[0])) if len(x) > 1 else np.ones(len(x))
        return pd.DataFrame({"column": block["column"].to_numpy()[own], "_x": x[own], "_factor": factor[own]})

    scored = blocks.groupBy("column", BLOCK).applyInPandas(score, "column int, _x double, _factor double")
    # Copies of a value can differ in factor only through which of their equally near neighbours were taken.
    far = scored.groupBy("column", "_x").agg(F.avg("_factor").alias("_factor")).filter(F.col("_factor") > THRESHOLD)
    far = stored(far.select("column", "_x"))
    out = df
    for i, c in enumerate(columns):
        own = far.filter(F.col("column") == i).select(F.col("_x").alias(f"_far{i}"))
        out = out.join(own, number(df, c) == F.col(f"_far{i}"), "left").withColumn(outputs[c], F.col(f"_far{i}").isNotNull()).drop(f"_far{i}")
    return out


def local_factor(x: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor of sorted values; exact for rows at least 3k from an artificial edge."""
    n = len(x)
    k = min(k, n - 1)
    offsets = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
    at = np.arange(n)[:, None] + offsets[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    distance = np.where(inside, np.abs(x[at] - x[:, None]), np.inf)
    nearest = np.argsort(distance, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(at, nearest, axis=1)
    near_distance = np.take_along_axis(distance, nearest, axis=1)
    k_distance = near_distance[:, -1]
    reach = np.maximum(near_distance, k_distance[near])
    density = 1.0 / (reach.mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / density
