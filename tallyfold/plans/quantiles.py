"""Exact quantiles (linear interpolation) without holding a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyfold.plans.ordering import attach, running_sum
from tallyfold.plans.scale import DEFAULT, Scale

#: Accuracy of the sketches: the rank of a value they give is off by a share of at most 1 / ACCURACY.
ACCURACY = 10_000


def quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], rows: int | None = None, scale: Scale = DEFAULT
) -> dict[str, list[float | None]]:
    """Quantiles of each expression, nulls ignored. Only the answers reach the driver.

    The first read makes a mergeable sketch of every column, which brackets each wanted rank by two values close to it. The second counts the
    values between the brackets, and within each one in equal-width bins (counts combine before the shuffle, so hot values and skew do not matter). A bin that holds the
    wanted rank and one value is the answer; a bin of several values, or a bracket that missed its rank, is cut again. Infinities are
    counted apart, as the ends of the order.
    """
    if not columns:
        return {}
    names = list(columns)
    base = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    endless = F.lit(math.inf)
    margin = 2 / ACCURACY
    fractions = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    bounds = base.agg(
        *[
            part.alias(f"{k}{i}")
            for i in range(len(names))
            for c in [F.col(f"c{i}")]
            for finite in [F.when(F.abs(c) < endless, c)]
            for k, part in (
                ("n", F.count(c)), ("lo", F.min(finite)), ("hi", F.max(finite)),
                ("below", F.count_if(c == -endless)), ("above", F.count_if(c == endless)),
                ("near", F.percentile_approx(c, fractions, ACCURACY)),
            )
        ]
    ).first()
    wanted: dict[tuple[int, int], float | None] = {}
    ranks: dict[int, set[int]] = {}
    brackets: dict[int, list[tuple[float, float]]] = {}
    for i in range(len(names)):
        near = dict(zip(fractions, bounds[f"near{i}"] or []))
        for p in probs:
            if not bounds[f"n{i}"]:
                continue
            at = (bounds[f"n{i}"] - 1) * p
            for rank in {math.floor(at), math.ceil(at)}:
                if rank < bounds[f"below{i}"]:
                    wanted[(i, rank)] = -math.inf
                elif rank >= bounds[f"n{i}"] - bounds[f"above{i}"]:
                    wanted[(i, rank)] = math.inf
                else:
                    ranks.setdefault(i, set()).add(rank)
                    least, most = bounds[f"lo{i}"], bounds[f"hi{i}"]
                    lo = least if p <= margin else max(least, near[max(0.0, p - margin)])
                    hi = most if p >= 1 - margin else min(most, near[min(1.0, p + margin)])
                    brackets.setdefault(i, []).append((lo, hi))
    if ranks:
        open_ranges, closed = _first_cut(base, ranks, {i: _disjoint(b) for i, b in brackets.items()}, bounds, scale)
        wanted.update(closed)
        while open_ranges:
            open_ranges, closed = _narrow(base, open_ranges, scale)
            wanted.update(closed)
    out = {}
    for i, name in enumerate(names):
        n = bounds[f"n{i}"]
        values = []
        for p in probs:
            if not n:
                values.append(None)
                continue
            at = (n - 1) * p
            low, high = wanted[(i, math.floor(at))], wanted[(i, math.ceil(at))]
            values.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        out[name] = values
    return out


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(set(brackets)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the equal-width bin of a value between ``lo`` and ``hi``."""
    if hi > lo and hi / 2 - lo / 2 == 0:
        return F.when(value > lo, 1).otherwise(0)  # neighbours among the smallest doubles
    if hi > lo:
        # Halves keep the width finite for intervals as wide as the double range.
        share = (value / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return F.lit(0)


def _first_cut(base: DataFrame, ranks: dict, brackets: dict, bounds: Row, scale: Scale) -> tuple[dict, dict]:
    """Counts every finite value once: in a bin of the bracket that holds it, or in the gap before, between or after the brackets of its column."""
    endless = F.lit(math.inf)
    bins = max(16, min(scale.bins, scale.collected // sum(map(len, brackets.values()))))
    cells = []
    for i, own in brackets.items():
        value = F.col(f"c{i}")
        # Part 2k is the gap before bracket k, part 2k + 1 the bracket.
        place = F.when(value < own[0][0], F.struct(F.lit(0).alias("part"), F.lit(0).alias("bin")))
        for k, (lo, hi) in enumerate(own):
            if k:
                place = place.when(value < lo, F.struct(F.lit(2 * k).alias("part"), F.lit(0).alias("bin")))
            place = place.when(value <= hi, F.struct(F.lit(2 * k + 1).alias("part"), _bin(value, lo, hi, bins).alias("bin")))
        place = place.otherwise(F.struct(F.lit(2 * len(own)).alias("part"), F.lit(0).alias("bin")))
        cells.append(F.when(F.abs(value) < endless, F.struct(F.lit(i).alias("i"), place.alias("place"), value.alias("value"))))
    counted = (
        base.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("cell"))
        .groupBy("cell.i", "cell.place")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cell.value").alias("lo"), F.max("cell.value").alias("hi"))
    )
    # At most ``scale.collected`` bins and a few gaps per column, whatever the data.
    table: dict[int, list] = {}
    for row in sorted(counted.collect(), key=lambda r: (r["i"], r["place"]["part"], r["place"]["bin"])):
        table.setdefault(row["i"], []).append(row)
    still_open, closed = {}, {}
    for i, own in ranks.items():
        for rank in own:
            seen = bounds[f"below{i}"]
            for row in table[i]:
                if rank < seen + row["n"]:
                    if row["lo"] == row["hi"]:
                        closed[(i, rank)] = row["lo"]
                    else:
                        still_open[(i, rank)] = (row["lo"], row["hi"], seen)
                    break
                seen += row["n"]
    return still_open, closed


def _narrow(base: DataFrame, open_ranges: dict, scale: Scale) -> tuple[dict, dict]:
    """One round: bin the values of the open intervals and pick, per wanted rank, the bin holding it."""
    intervals = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in open_ranges.items()})
    bins = max(16, min(scale.bins, scale.collected // len(intervals)))
    cells = []
    for number, (i, lo, hi) in enumerate(intervals):
        value = F.col(f"c{i}")
        bin_no = _bin(value, lo, hi, bins)
        cells.append(
            F.when(
                value.between(lo, hi),
                F.struct(F.lit(number).alias("interval"), bin_no.alias("bin"), value.alias("value")),
            )
        )
    counted = (
        base.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("cell"))
        .groupBy("cell.interval", "cell.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cell.value").alias("lo"), F.max("cell.value").alias("hi"))
    )
    # At most ``scale.collected`` rows, whatever the data.
    table: dict[int, list] = {}
    for row in counted.orderBy("interval", "bin").collect():
        table.setdefault(row["interval"], []).append(row)
    still_open, closed = {}, {}
    for (i, rank), (lo, hi, below) in open_ranges.items():
        seen = below
        for row in table[intervals.index((i, lo, hi))]:
            if rank < seen + row["n"]:
                if row["lo"] == row["hi"]:
                    closed[(i, rank)] = row["lo"]
                else:
                    still_open[(i, rank)] = (row["lo"], row["hi"], seen)
                break
            seen += row["n"]
    return still_open, closed


def group_quantile(
    df: DataFrame, keys: list[str], value: Column, prob: float, output: str, rows: int, scale: Scale = DEFAULT
) -> DataFrame:
    """Exact quantile per group, one row per group, nulls of ``value`` ignored."""
    named = [F.col(f"`{k}`") for k in keys]
    base = df.select(*named, value.cast("double").alias("value"))
    counted = base.groupBy(*named, "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy(*named).agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_size"))
    filled = sizes.filter("_size is not null")
    ranked = running_sum(counted.filter("value is not null"), keys, ["value"], F.col("n"), rows, "_below", scale)
    at = (F.col("_size") - 1) * F.lit(prob)
    low, high = F.floor(at), F.ceil(at)
    end = F.col("_below") + F.col("n")
    picked = (
        attach(ranked, filled, keys)
        .groupBy(*named)
        .agg(
            F.max(F.when((F.col("_below") <= low) & (low < end), F.col("value"))).alias("_lo"),
            F.max(F.when((F.col("_below") <= high) & (high < end), F.col("value"))).alias("_hi"),
            F.max(at - low).alias("_part"),
        )
        .select(
            *named,
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
            .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
            .alias(output),
        )
    )
    empty = sizes.filter("_size is null").select(*named, F.lit(None).cast("double").alias(output))
    return picked.unionByName(empty)


