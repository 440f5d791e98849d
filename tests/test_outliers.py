import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import outliers as O
from tallyfold.operators.isolation import StepScore, _tree, average_path
from tallyfold.operators.neighbours import density_outliers
from tallyfold.plans.scale import Scale

TINY = Scale(chunk_rows=40, bins=16)


def frame(spark, values, name="v", kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row int, {name} {kind}")


def flagged(spark, values, method, threshold=1.5, name="v"):
    df = frame(spark, values, name)
    bounds = O.fit(df, method, threshold, [name])
    return sorted(r["row"] for r in O.outlier_cells(df, bounds, ["row"]).collect()), bounds


SPREAD = [10.5, 11.2, 9.7, 10.1, 10.9, 9.9, 10.4, 10.0, 11.0, 10.6, 9.5, 60.25]


def test_iqr_bounds_and_flags(spark):
    rows, (b,) = flagged(spark, SPREAD, "iqr")
    low, high = np.percentile(SPREAD, [25, 75])
    assert rows == [11]
    assert b.lower == pytest.approx(low - 1.5 * (high - low)) and b.upper == pytest.approx(high + 1.5 * (high - low))


def test_log_iqr_skips_negative_values(spark):
    rows, _ = flagged(spark, SPREAD + [-1.5], "log_iqr")
    assert rows == []
    rows, (b,) = flagged(spark, SPREAD, "log_iqr")
    low, high = np.percentile(np.log1p(SPREAD), [25, 75])
    assert rows == [11] and b.upper == pytest.approx(math.expm1(high + 1.5 * (high - low)))


def test_mad_cutoff_only_above_three(spark):
    _, (b,) = flagged(spark, SPREAD, "mad", 3.0)
    assert b.cutoff == 3.5
    rows, (b,) = flagged(spark, SPREAD, "mad", 4.0)
    assert b.cutoff == 4.0 and rows == [11]


def test_zero_spread_finds_nothing(spark):
    flat = [4.5] * 9 + [100.5]
    assert flagged(spark, flat, "iqr")[0] == []
    assert flagged(spark, flat, "mad")[0] == []
    # IQR is zero but MAD is not the other way round either: three different centres.
    assert flagged(spark, [1.5, 2.5, 3.5, 4.5, 5.5, 90.5], "mad")[0] == [5]


def test_zscore_population_flags_sample_caps(spark):
    rows, (b,) = flagged(spark, SPREAD, "zscore", 3.0)
    assert rows == [11]
    assert b.spread == pytest.approx(np.std(SPREAD)) and b.cap_upper == pytest.approx(np.mean(SPREAD) + 3 * np.std(SPREAD, ddof=1))


@pytest.mark.parametrize("rows, expected", [(3, 0), (4, 0), (5, 1)])
def test_least_table_size(spark, rows, expected):
    df = frame(spark, [float(i) + 0.5 for i in range(rows)])
    assert len(O.fit(df, "iqr", 1.5, ["v"])) == expected


@pytest.mark.parametrize("values, method", [(7, "skip"), (8, "mad")])
def test_auto_needs_eight_values(spark, values, method):
    df = frame(spark, [1.5 - 3 * (i % 3) + i for i in range(values)])
    assert O.fit(df, "auto", 1.5, ["v"])[0].method == method


def test_domain_rule_survives_skip(spark):
    df = frame(spark, [-5.0, 50.0, 120.0, 30.0, 40.0], "rate")
    bounds = O.fit(df, "isolation_forest", 1.5, ["rate"])
    assert bounds[0].method == "skip"
    table = O.bounds_table(df, bounds).first()
    assert table["outliers"] == 2 and table["severity"] == "critical" and table["suggested_action"] == "flag"


def test_percent_cap_quirk_and_strict(spark):
    values = [50.0, 60.0, 40.0, 55.0, 45.0, 52.0, 48.0, 51.0, 120.0, -5.0]
    df = frame(spark, values, "rate")
    bounds = O.fit(df, "lof", 1.5, ["rate"])
    got = lambda strict: {r["row"]: r["rate"] for r in O.cap(df, bounds, strict).collect()}
    # Domain outliers keep their value under lof; only negatives are mended unless strict.
    assert got(False)[9] == 0.0 and got(False)[8] == 120.0
    assert got(True)[8] == 100.0


def test_cap_stays_in_bounds(spark):
    df = frame(spark, [float(i % 17) + 0.5 for i in range(200)] + [500.0, 900.0, -400.0])
    bounds = O.fit(df, "iqr", 1.5, ["v"])
    capped = O.cap(df, bounds)
    low, high = capped.agg(F.min("v"), F.max("v")).first()
    assert low >= min(bounds[0].lower, 0.0) and high <= bounds[0].upper
    assert capped.count() == df.count()


def test_remove_is_sequential_joint_is_not(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.lognormal(3, 1, 300), rng.lognormal(3, 1, 300))]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "row string, a double, b double")
    pdf = pd.DataFrame(rows, columns=["a", "b"])

    def keep(part, column):
        low, high = part[column].quantile([0.25, 0.75])
        return part[(part[column] >= low - 1.5 * (high - low)) & (part[column] <= high + 1.5 * (high - low))]

    assert O.remove(df, "iqr").count() == len(keep(keep(pdf, "a"), "b"))
    assert O.remove(df, "iqr", joint=True).count() == len(keep(pdf, "a").index.intersection(keep(pdf, "b").index))


def test_flag_then_counts_agree(spark):
    df = frame(spark, SPREAD + [None])
    bounds = O.fit(df, "iqr", 1.5, ["v"])
    out = O.flag(df, bounds)
    assert out.filter("v_outlier").count() == O.outlier_counts(df, bounds).first()["outliers"] == 1
    assert out.filter("v is null").first()["v_outlier"] is False


def naive_lof(values: list[float], k: int) -> list[float]:
    x = np.array(values)
    gaps = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(gaps, np.inf)
    near = np.argsort(gaps, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(gaps, near, axis=1)
    limit = reach[:, -1]
    density = 1 / (np.maximum(reach, limit[near]).mean(axis=1) + 1e-10)
    return list(density[near].mean(axis=1) / density)


@pytest.mark.parametrize("scale, block", [(Scale(), 50_000), (TINY, 70)])
def test_lof_matches_brute_force(spark, scale, block):
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.normal(0, 10, 400)] + [3.25] * 150 + [80.0, -95.0, 81.0, 200.0]
    df = frame(spark, values)
    out = density_outliers(df, "v", "hit", block, scale)
    got = {r["v"] for r in out.filter("hit").collect()}
    factors = naive_lof(values, 20)
    want = {v for v, f in zip(values, factors) if f > 1.5}
    assert got == want and 200.0 in got
    assert out.count() == len(values)


def test_isolation_tree_is_a_step_function():
    rng = np.random.default_rng(0)
    values = np.sort(rng.normal(0, 1, 200))
    cuts, leaves = _tree(values, 8, rng)
    assert len(leaves) == len(cuts) + 1 and np.all(np.diff(cuts) >= 0)
    assert average_path(2) == 1.0 and average_path(1) == 0.0


def test_isolation_forest_marks_the_far_value(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(100, 2, 500)] + [500.0]
    df = frame(spark, values)
    bounds = O.fit(df, "isolation_forest", 1.5, ["v"])
    assert isinstance(bounds[0].steps, StepScore)
    scores = {r["v"]: r["s"] for r in df.select("v", bounds[0].steps.score(F.col("v")).alias("s")).collect()}
    assert scores[500.0] == max(scores.values()) > 0.6
    assert min(scores.values()) < 0.5


def test_reviewed_bounds_by_selected_rows(spark):
    df = frame(spark, SPREAD + [70.5])
    bounds = O.fit(df, "iqr", 1.5, ["v"])
    selected = spark.createDataFrame([(12,)], "row int")
    kept = O.apply_bounds(df, bounds, "remove", selected=selected, key=["row"])
    assert sorted(r["row"] for r in kept.collect()) == list(range(12))
    capped = O.apply_bounds(df, bounds, "cap", selected=selected, key=["row"])
    by_row = {r["row"]: r["v"] for r in capped.collect()}
    assert by_row[11] == 60.25 and by_row[12] == pytest.approx(bounds[0].upper)


@pytest.mark.parametrize("method", ["iqr", "log_iqr", "mad"])
def test_bounds_do_not_depend_on_the_size_path(spark, method):
    values = [float(v) for v in np.random.default_rng(9).lognormal(2, 1, 300)] + [7.5] * 150
    df = frame(spark, values)
    plain, searched = O.fit(df, method, 1.5, ["v"])[0], O.fit(df, method, 1.5, ["v"], scale=TINY)[0]
    assert searched.lower == pytest.approx(plain.lower) and searched.upper == pytest.approx(plain.upper)
