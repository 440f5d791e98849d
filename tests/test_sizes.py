"""One plan form at every size: infinities, text order keys, and samples of rows rather than contents."""

import math

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import kpi, pps
from tallyfold.plans.ordering import carried, with_position
from tallyfold.plans.quantiles import group_quantile, quantiles
from tallyfold.plans.scale import Scale
from tallyfold.streaming.ingest import run_stages

SIZES = [Scale(), Scale(chunk_rows=7, bins=16)]


@pytest.mark.parametrize("scale", SIZES)
def test_infinity_ends(spark, scale):
    values = [math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf, 5e-324, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = quantiles(df, {"v": F.col("v")}, probs, len(values), scale)["v"]
    ordered = sorted(values)
    for p, got in zip(probs, found):
        at = (len(values) - 1) * p
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert got == (low if low == high else low + (high - low) * (at - math.floor(at)))
    grouped = group_quantile(df.withColumn("k", F.lit(1)), ["k"], F.col("v"), 1.0, "m", len(values), scale)
    assert grouped.first()["m"] == math.inf


@pytest.mark.parametrize("scale", SIZES)
def test_text_order_keys(spark, scale):
    names = [f"{a}é{b}" for a in "zyxab" for b in ("", "0", "longer text", "longer texts")] + [None]
    df = spark.createDataFrame([(n, i if i % 3 else None) for i, n in enumerate(names)], "name string, v int")
    found = {r.name: r._position for r in with_position(df, ["name"], len(names), scale=scale).collect()}
    ordered = sorted(names, key=lambda n: (n is not None, (n or "").encode()))
    assert found == {n: i for i, n in enumerate(ordered)}
    last, want = None, {}
    own = dict(zip(names, [i if i % 3 else None for i in range(len(names))]))
    for n in ordered:
        last = own[n] if own[n] is not None else last
        want[n] = last
    filled = carried(df, {"f": F.col("v")}, ["name"], len(names), scale=scale)
    assert {r.name: r.f for r in filled.collect()} == want


def test_sample_draws_rows_not_contents(spark):
    df = spark.range(40_000).selectExpr("CASE WHEN id % 4 < 3 THEN 'x' ELSE 'y' END AS a", "CASE WHEN id % 4 < 3 THEN 'p' ELSE 'q' END AS b")
    sample = {r.a: r["count"] for r in pps.sampled(df, ["a", "b"]).groupBy("a").count().collect()}
    assert sum(sample.values()) == 5000 and abs(sample["x"] - 3750) < 150
    scores = {(r.x, r.y): r.ppscore for r in pps.pps_matrix(df).collect()}
    assert scores == {("a", "b"): 1.0, ("b", "a"): 1.0}


def test_missing_numbers_are_not_counted(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", float("nan")), ("g", float("nan")), ("g", None)], "k string, v double")
    assert kpi.group_values(df, ["k"], "v", "count").first()["value"] == 1
    assert kpi.group_values(df, ["k"], "v", "nunique").first()["value"] == 1
    assert kpi.mode_kpi(df, "v").collect() == [(1.0, 1)]


def test_a_batch_whose_rows_cannot_be_stored_fails(spark, tmp_path):
    def broken(df):
        raise ValueError("no room")

    batch = spark.range(3)
    with pytest.raises(ValueError):
        run_stages(batch, 0, str(tmp_path), {"rows": broken, "report": lambda df: df})
    assert spark.read.parquet(f"{tmp_path}/status").filter("status LIKE 'failed%'").count() == 1
    run_stages(batch, 1, str(tmp_path), {"rows": lambda df: df, "report": broken})
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 3
