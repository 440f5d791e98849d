"""One-dimensional isolation forest as a step function.

On a single column every isolation tree is a set of cut points, so a whole forest is one step function
of the value. The trees are grown from a sample of bounded size; scoring a table is a binary
search per value inside Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES = 100
TREE_ROWS = 256
SEED = 42


@dataclass(frozen=True)
class StepScore:
    """``levels[i]`` is the anomaly score of values in ``(cuts[i-1], cuts[i]]``."""

    cuts: tuple[float, ...]
    levels: tuple[float, ...]

    def score(self, cell: Column) -> Column:
        cuts, levels = np.array(self.cuts), np.array(self.levels)

        @F.pandas_udf("double")
        def lookup(values: pd.Series) -> pd.Series:
            found = pd.Series(levels[np.searchsorted(cuts, values.to_numpy("float64"), side="left")])
            return found.where(values.notna().to_numpy())

        return lookup(cell)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def fit_isolation(df: DataFrame, cell: Column) -> StepScore | None:
    """Grows the forest from a seeded uniform sample: at most ``TREES * TREE_ROWS`` values reach the driver.

    The table is thinned to about twice that many rows before they are put in random order, so the tasks
    together hand on no more than that either."""
    pool = df.select(cell.alias("v")).filter("v is not null")
    share = 2.0 * TREES * TREE_ROWS / max(pool.count(), 1)
    thin = pool.sample(fraction=share, seed=SEED) if share < 1.0 else pool
    drawn = thin.orderBy(F.rand(SEED)).limit(TREES * TREE_ROWS)
    values = np.sort(np.array([r["v"] for r in drawn.select("v").collect()], dtype="float64"))
    if not len(values):
        return None
    rng = np.random.default_rng(SEED)
    size = min(TREE_ROWS, len(values))
    depth_limit = math.ceil(math.log2(max(size, 2)))
    trees = [_tree(np.sort(rng.choice(values, size, replace=False)), depth_limit, rng) for _ in range(TREES)]
    cuts = np.unique(np.concatenate([t[0] for t in trees]))
    total = np.zeros(len(cuts) + 1)
    for tree_cuts, depths in trees:
        # Each piece of the merged function lies in exactly one leaf of the tree.
        total += depths[np.searchsorted(tree_cuts, np.append(cuts, np.inf), side="left")]
    scale = max(average_path(size), 1e-12)
    return StepScore(tuple(cuts), tuple(2.0 ** (-(total / TREES) / scale)))


def _tree(values: np.ndarray, depth_limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cut points and leaf depths, left to right, of one tree over sorted values."""
    cuts: list[float] = []
    leaves: list[float] = []
    stack: list[tuple] = [(0, len(values), 0)]
    while stack:
        item = stack.pop()
        if len(item) == 1:
            cuts.append(item[0])
            continue
        start, end, depth = item
        low, high = (values[start], values[end - 1]) if end > start else (0.0, 0.0)
        if depth >= depth_limit or end - start <= 1 or low == high:
            leaves.append(depth + average_path(end - start))
            continue
        cut = rng.uniform(low, high)
        middle = start + int(np.searchsorted(values[start:end], cut, side="right"))
        stack.extend([(middle, end, depth + 1), (cut,), (start, middle, depth + 1)])
    return np.array(cuts), np.array(leaves)
