"""Predictive power score of all ordered column pairs.

The score is defined on a sample of at most 5000 rows: a depth-4 tree on one feature, cross-validated,
against a naive baseline. Rows are sampled uniformly over the whole table as a bounded top-k by row hash, the
one documented bound of the fit; the pairs are then spread over the cluster, one pair of the sample per Arrow group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.operators.profile import numeric_columns
from tallyfold.plans.scale import row_count

# Fixed values of the definition.
SAMPLE_ROWS = 5_000
SEED = 42
DEPTH = 4
LEAST_ROWS = 10
LEAST_SCORE = 0.3

# Rows that pass the hash limit, as a multiple of the sample; copies of one row that one task numbers.
THINNED = 4
COPIES = 100_000

RESULT = "x string, y string, ppscore double, baseline_score double, model_score double, case string"


def pps_matrix(df: DataFrame, columns: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(x, y, ppscore, baseline_score, model_score, case)`` for every ordered pair of columns."""
    columns = columns or df.columns
    numbers = set(numeric_columns(df))
    sample = sampled(df, columns, sample_rows)
    texts = [
        F.when(F.col(f"`{c}`").isNotNull(), F.struct(
            number(df, c).alias("number") if c in numbers else F.lit(None).cast("double").alias("number"),
            F.col(f"`{c}`").cast("string").alias("text"),
        ))
        for c in columns
    ]
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if i != j]
    cells = F.array(
        *[
            F.struct(
                F.lit(columns[i]).alias("x"),
                F.lit(columns[j]).alias("y"),
                F.lit(columns[i] in numbers).alias("x_numeric"),
                F.lit(columns[j] in numbers).alias("y_numeric"),
                texts[i].alias("a"),
                texts[j].alias("b"),
            )
            for i, j in pairs
        ]
    )
    long = sample.select("_row", F.inline(cells)).select(
        "_row", "x", "y", "x_numeric", "y_numeric",
        F.col("a.number").alias("x_number"), F.col("a.text").alias("x_text"),
        F.col("b.number").alias("y_number"), F.col("b.text").alias("y_text"),
    )
    return long.groupBy("x", "y").applyInPandas(score_pair, RESULT)


def sampled(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """A uniform sample of at most ``rows`` rows, the same ones on every run; ``_row`` orders them.

    Equal rows are counted first and numbered, so that every row, copies too, has a hash of its own and a combination is drawn as
    often as the table holds it. Only hashes below a limit that leaves a few times the sample are sorted."""
    named = [F.col(f"`{c}`") for c in columns]
    counted = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"))
    content = counted.withColumn("_content", F.xxhash64(F.lit(SEED), *named))
    spread = content.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES)))).repartition("_content", "_part")
    last = F.least(F.col("_n"), (F.col("_part") + 1) * COPIES)
    numbered = spread.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES + 1, last)))
    hashed = numbered.select(F.xxhash64(F.lit(SEED), "_content", "_copy").alias("_row"), *named)
    share = min(1.0, THINNED * rows / max(row_count(df), 1))
    limit = F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    return hashed.filter(F.col("_row") <= limit).orderBy("_row", *named).limit(rows)


def pps_relationships(scores: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    return scores.filter(F.col("ppscore") > least).select(
        F.col("x").alias("col_a"),
        F.col("y").alias("col_b"),
        F.lit("predictive").alias("type"),
        F.col("ppscore").alias("strength"),
        F.concat("x", F.lit(" → "), "y").alias("direction"),
        F.lit("custom_pps").alias("method"),
        F.concat("y", F.lit(" follows from "), "x").alias("insight"),
    )


def score_pair(rows: pd.DataFrame) -> pd.DataFrame:
    """Scores one pair from its sampled rows."""
    first = rows.iloc[0]
    x_numeric, y_numeric = bool(first["x_numeric"]), bool(first["y_numeric"])
    keep = rows["x_text"].notna() & rows["y_text"].notna()
    if x_numeric:
        keep &= rows["x_number"].notna()
    if y_numeric:
        keep &= rows["y_number"].notna()
    rows = rows[keep].sort_values(["_row", "x_text", "y_text"], kind="stable")
    case = f"{'numeric' if x_numeric else 'categorical'}_to_{'numeric' if y_numeric else 'categorical'}"
    if len(rows) < LEAST_ROWS:
        scores = (0.0, 0.0, 0.0, "insufficient_data")
    else:
        x = rows["x_number"].to_numpy("float64") if x_numeric else _codes(rows["x_text"])
        if y_numeric:
            scores = (*_regression(x, rows["y_number"].to_numpy("float64")), case)
        else:
            scores = (*_classification(x, _codes(rows["y_text"]).astype(int)), case)
    return pd.DataFrame(
        [(first["x"], first["y"], *scores)],
        columns=["x", "y", "ppscore", "baseline_score", "model_score", "case"],
    )


def _codes(texts: pd.Series) -> np.ndarray:
    return np.unique(texts.to_numpy(str), return_inverse=True)[1].astype("float64")


def _normalised(model: float, base: float) -> float:
    if base >= 1.0 or model <= base:
        return 0.0
    return float(np.clip((model - base) / (1.0 - base), 0.0, 1.0))


def _fold_count(n: int) -> int:
    return min(5, n // 10)


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Mean cross-validated r² over contiguous folds; fewer than two folds score 0."""
    folds = _fold_count(len(x))
    if folds < 2:
        return 0.0, 0.0, 0.0
    least = max(1, len(x) // 50)
    results = []
    for test in np.array_split(np.arange(len(x)), folds):
        train = np.setdiff1d(np.arange(len(x)), test, assume_unique=True)
        guess = fit_tree(x[train], y[train][:, None], least)(x[test])[:, 0]
        spread = ((y[test] - y[test].mean()) ** 2).sum()
        missed = ((y[test] - guess) ** 2).sum()
        results.append(1.0 - missed / spread if spread > 0 else float(missed == 0))
    model = max(0.0, float(np.mean(results)))
    return round(_normalised(model, 0.0), 3), 0.0, round(model, 3)


def _classification(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Mean cross-validated accuracy over folds that keep the class shares, against the largest class."""
    counts = np.bincount(y)
    base = float(counts.max() / len(y))
    folds = _fold_count(len(x))
    model = base
    if folds >= 2 and counts.max() >= folds:
        fold_of = _stratified(y, folds)
        one_hot = np.eye(len(counts))[y]
        least = max(1, len(x) // 50)
        results = []
        for k in range(folds):
            test = fold_of == k
            shares = fit_tree(x[~test], one_hot[~test], least)(x[test])
            results.append((shares.argmax(axis=1) == y[test]).mean())
        model = float(np.mean(results))
    return round(_normalised(model, base), 3), round(base, 3), round(model, 3)


def _stratified(y: np.ndarray, folds: int) -> np.ndarray:
    """Fold per row: the classes, numbered by first appearance, are dealt out in turn so that each fold
    gets its share, and inside a class the folds take consecutive rows."""
    first_seen = np.argsort(np.unique(y, return_index=True)[1])
    rank_of_class = np.empty(len(first_seen), dtype=int)
    rank_of_class[first_seen] = np.arange(len(first_seen))
    ranked = rank_of_class[np.unique(y, return_inverse=True)[1]]
    in_order = np.sort(ranked)
    shares = np.array([np.bincount(in_order[k::folds], minlength=len(first_seen)) for k in range(folds)])
    fold_of = np.empty(len(y), dtype=int)
    for label in range(len(first_seen)):
        fold_of[ranked == label] = np.repeat(np.arange(folds), shares[:, label])
    return fold_of


def fit_tree(x: np.ndarray, targets: np.ndarray, least: int):
    """Greedy depth-limited tree on one feature. ``targets`` holds one column for a number or one 0/1 column
    per class: in both cases the best cut is the one with the largest between-part sum of squares."""
    order = np.argsort(x, kind="stable")
    xs, sums = x[order], np.vstack([np.zeros(targets.shape[1]), np.cumsum(targets[order], axis=0)])
    cuts: list[float] = []
    means: list[np.ndarray] = []

    def grow(start: int, end: int, depth: int) -> None:
        cut = _best_cut(xs, sums, start, end, least) if depth < DEPTH else None
        if cut is None:
            means.append((sums[end] - sums[start]) / (end - start))
            return
        grow(start, cut, depth + 1)
        cuts.append((xs[cut - 1] + xs[cut]) / 2.0)
        grow(cut, end, depth + 1)

    grow(0, len(xs), 0)
    edges, leaves = np.array(cuts), np.array(means)
    return lambda values: leaves[np.searchsorted(edges, values, side="left")]


def _best_cut(xs: np.ndarray, sums: np.ndarray, start: int, end: int, least: int) -> int | None:
    at = np.arange(start + least, end - least + 1)
    at = at[(at > start) & (at < end)]
    at = at[xs[at - 1] < xs[at]]
    if not len(at):
        return None
    left = sums[at] - sums[start]
    right = sums[end] - sums[at]
    gain = (left**2).sum(axis=1) / (at - start) + (right**2).sum(axis=1) / (end - at)
    whole = ((sums[end] - sums[start]) ** 2).sum() / (end - start)
    best = int(np.argmax(gain))
    return int(at[best]) if gain[best] > whole + 1e-12 * max(1.0, abs(whole)) else None
