"""The distributed forms of ordered work against plain Python, with tiny limits that force many chunks."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.plans import ordering as O
from tallyfold.plans.quantiles import group_quantile, quantiles
from tallyfold.plans.scale import Scale

TINY = Scale(chunk_rows=37, bins=16)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, a third one value; times tie heavily; some nulls."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(12)}"
        value = 5.0 if i % 3 == 1 else round(rng.lognormvariate(2, 2), 3)
        rows.append((i, key, None if rng.random() < 0.2 else value, 7 if rng.random() < 0.4 else rng.randrange(100)))
    frame = pd.DataFrame(rows, columns=["id", "key", "value", "t"])
    return spark.createDataFrame(rows, "id long, key string, value double, t long").repartition(5).cache(), frame


def test_chunks_cover_and_order(skewed):
    df, frame = skewed
    chunked = O.with_chunk(df, ["t", "id"], len(frame), TINY).toPandas()
    ordered = chunked.sort_values(["t", "id"])
    assert ordered[O.CHUNK].is_monotonic_increasing
    assert ordered[O.CHUNK].nunique() > 10
    # The heavily tied time is cut by the second column.
    assert ordered[ordered.t == 7][O.CHUNK].nunique() > 3


def test_chunks_of_keys_of_any_type(spark):
    rng = random.Random(9)
    rows = [(f"Customer#{i:09d}", None if i % 7 == 0 else i % 5, float("nan") if i % 11 == 0 else i / 3) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, few int, part double").repartition(4)
    df = df.withColumns(
        {
            "day": F.expr("date_add(date'2020-01-01', cast(substr(name, 10) AS int) % 400)"),
            "at": F.expr("timestamp_micros(cast(substr(name, 10) AS long) * 1001)"),
            "exact": F.expr("cast(substr(name, 10) AS decimal(20, 4)) / 7"),
            "raw": F.expr("unhex(sha2(name, 256))"),
        }
    )
    for order in (["name"], ["few", "name"], ["part", "name"], ["day", "at"], ["at"], ["exact"], ["raw"]):
        counts = O.with_chunk(df, order, 2000, Scale(chunk_rows=100)).groupBy(O.CHUNK).agg(
            F.count("*").alias("n"), F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")
        )
        ordered = counts.withColumn("fits", F.coalesce(F.lag("high").over(Window.orderBy(O.CHUNK)) < F.col("low"), F.lit(True))).collect()
        assert all(r.fits for r in ordered), order
        assert len(ordered) >= 15 and max(r.n for r in ordered) <= 300, order


def test_quantiles_take_two_reads(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 20_000
    data = {
        "even": rng.random(n), "long_tail": np.exp(rng.normal(0, 5, n)), "few": rng.integers(0, 5, n).astype(float),
        "endless": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)), "tiny": rng.normal(size=n) * 1e-310, "huge": rng.normal(size=n) * 1e307,
    }
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    again = []
    real = quantiles.__globals__["_narrow"]
    monkeypatch.setitem(quantiles.__globals__, "_narrow", lambda *a: again.append(1) or real(*a))
    probs = [0.25, 0.5, 0.75, 0.99]
    # Numbers next to the smallest doubles cannot be cut in even parts, few bins need more reads.
    for scale, most, names in ((Scale(), 0, [c for c in data if c != "tiny"]), (Scale(bins=16, collected=200), 9, list(data))):
        again.clear()
        got = quantiles(df, {c: F.col(c) for c in names}, probs, scale=scale)
        for c in names:
            ordered = np.sort(data[c])
            for p, value in zip(probs, got[c]):
                at = (n - 1) * p
                low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
                assert value == pytest.approx(low if low == high else low + (high - low) * (at - math.floor(at)), rel=1e-12)
        assert len(again) <= most


@pytest.mark.parametrize("scale", [TINY, Scale()])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_positions(skewed, scale, keys):
    df, frame = skewed
    got = O.with_position(df, ["t", "id"], len(frame), keys, scale).toPandas().set_index("id")[O.POSITION]
    ordered = frame.sort_values(["t", "id"])
    want = (ordered.groupby(keys).cumcount() if keys else pd.Series(range(len(ordered)), index=ordered.index)).sort_index()
    assert got.sort_index().tolist() == want.tolist()


@pytest.mark.parametrize("scale", [TINY, Scale()])
def test_average_ranks(skewed, scale):
    df, frame = skewed
    freq = df.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    got = {r["value"]: r["avg_rank"] for r in O.average_ranks(freq, [], len(frame), scale).collect()}
    want = frame.value.rank()
    assert all(got[v] == w for v, w in zip(frame.value, want) if v == v)


@pytest.mark.parametrize("scale", [TINY, Scale()])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("current", [True, False])
def test_carried(skewed, scale, forward, current):
    df, frame = skewed
    ahead, back = ({"seen": F.col("value")}, {}) if forward else ({}, {"seen": F.col("value")})
    out = O.carried(df, ahead, ["t", "id"], len(frame), ["key"], scale, back, current)
    got = out.toPandas().set_index("id")["seen"].sort_index()
    ordered = frame.sort_values(["t", "id"]).copy()
    step = (1 if forward else -1) * (0 if current else 1)
    ordered["shifted"] = ordered.groupby("key").value.shift(step) if step else ordered.value
    grouped = ordered.groupby("key").shifted
    want = (grouped.ffill() if forward else grouped.bfill()).sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_blocks_hold_all_neighbours(skewed):
    df, frame = skewed
    placed = O.with_position(df, ["id"], len(frame), [], TINY)
    spread = O.with_blocks(placed, 50, before=3, after=2)
    window = Window.partitionBy(O.BLOCK).orderBy(O.POSITION)
    seen = spread.withColumn("around", F.collect_list("id").over(window.rowsBetween(-3, 2))).filter(f"not {O.HALO}")
    for row in seen.collect():
        i = row["id"]
        assert row["around"] == list(range(max(0, i - 3), min(len(frame), i + 3)))
    assert seen.count() == len(frame)


@pytest.mark.parametrize("scale", [TINY, Scale()])
def test_attach_keeps_every_row(spark, skewed, scale):
    df, frame = skewed
    facts = df.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = O.attach(df, facts, ["value"]).toPandas()
    assert sorted(got.id) == sorted(frame.id)
    first = frame.groupby("value", dropna=False).id.min()
    for value, found in zip(got.value, got["first"]):
        assert found == (first[np.nan] if value != value else first[value])


@pytest.mark.parametrize("scale", [TINY, Scale()])
def test_quantiles(skewed, scale):
    df, frame = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, {"value": F.col("value"), "t": F.col("t"), "none": F.lit(None)}, probs, len(frame), scale)
    assert got["none"] == [None] * len(probs)
    for name in ("value", "t"):
        np.testing.assert_allclose(got[name], frame[name].quantile(probs).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("scale", [TINY, Scale()])
def test_group_quantile(skewed, scale):
    df, frame = skewed
    rows = group_quantile(df, ["key"], F.col("value"), 0.5, "median", len(frame), scale).collect()
    got = {r["key"]: r["median"] for r in rows}
    want = frame.groupby("key").value.median()
    assert set(got) == set(want.index)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12)
