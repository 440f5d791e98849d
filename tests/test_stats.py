import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import special
from tallyfold.operators import pps, relations, stats
from tallyfold.operators.roles import column_facts
from tallyfold.plans.scale import Scale

TINY = Scale(chunk_rows=30, bins=16)


# Tabulated values of the distributions.
@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (124.342113, 100, 0.05)])
def test_chi2_tail(x, df, p):
    assert special.chi2_tail(x, df) == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize("t, df, p", [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (1.983972, 100, 0.05), (2.750, 30, 0.01)])
def test_t_tail(t, df, p):
    assert special.t_tail_two_sided(t, df) == pytest.approx(p, rel=2e-4)


@pytest.mark.parametrize("f, a, b, p", [(161.4476, 1, 1, 0.05), (4.102821, 2, 10, 0.05), (2.353809, 4, 157, 0.0563)])
def test_f_tail(f, a, b, p):
    assert special.f_tail(f, a, b) == pytest.approx(p, rel=2e-2)


def test_t_and_f_agree():
    assert special.t_tail_two_sided(2.1, 17) == pytest.approx(special.f_tail(2.1**2, 1, 17), rel=1e-9)


def test_yates_on_two_by_two(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "g string, h string")
    row = stats.chi_square_pairs(df, [("g", "h")]).first()
    observed = np.array([[12, 5], [3, 9]])
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    yates = ((np.abs(observed - expected) - 0.5) ** 2 / expected).sum()
    plain = ((observed - expected) ** 2 / expected).sum()
    assert row["statistic"] == pytest.approx(yates) and row["degrees"] == 1
    n = observed.sum()
    corrected = 2 - 1 / (n - 1)
    assert row["cramers_v"] == pytest.approx(np.sqrt((plain / n - 1 / (n - 1)) / (corrected - 1)))


@pytest.mark.parametrize("rows", [[("a", "x")] * 12 + [("b", "y")] * 9, [("a", "x")] * 12 + [("a", "y")] * 4 + [("b", "y")] * 9])
def test_absent_cells_count(spark, rows):
    df = spark.createDataFrame(rows, "g string, h string")
    found = stats.contingency(df, [("g", "h")]).first()
    table = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows]))
    o = table.to_numpy()
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    gap = np.abs(o - e)
    assert found["chi2"] == pytest.approx((gap**2 / e).sum())
    assert found["chi2_yates"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())
    assert found["least_cell"] == o.min()


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_kruskal_with_ties(spark, scale):
    # Worked by hand from average ranks.
    groups = {"a": [1, 2, 2, 3, 9], "b": [2, 4, 5, 5, 6], "c": [7, 8, 8, 9, 9], "alone": [4]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    row = stats.kruskal_pairs(df, [("g", "v")], scale=scale).first()
    kept = pd.DataFrame(rows, columns=["g", "v"]).query("g != 'alone'")
    ranks, n = kept.v.rank(), len(kept)
    h = 12 / (n * (n + 1)) * (ranks.groupby(kept.g).sum() ** 2 / kept.groupby("g").size()).sum() - 3 * (n + 1)
    counts = kept.v.value_counts()
    h /= 1 - (counts**3 - counts).sum() / (n**3 - n)
    assert row["statistic"] == pytest.approx(h) and row["groups"] == 3
    assert row["p_value"] == pytest.approx(special.chi2_tail(h, 2))
    assert 0 <= row["eta_squared"] <= 1


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_spearman_with_and_without_gaps(spark, scale):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 200), "b": rng.normal(0, 1, 200)})
    frame["c"] = frame.a * 2 + rng.integers(0, 5, 200)
    frame.loc[rng.random(200) < 0.3, "b"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "a long, b double, c long")
    got = {(r["col_a"], r["col_b"]): r["rho"] for r in stats.spearman_rho(df, ["a", "b", "c"], scale=scale).collect()}
    want = {}
    for x, y in got:
        both = frame[[x, y]].dropna()
        want[(x, y)] = both[x].rank().corr(both[y].rank())
    assert got == pytest.approx(want)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_anova_by_hand(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    row = stats.anova_pairs(df, [("g", "v")]).first()
    assert row["statistic"] == pytest.approx(9.3, abs=0.05) and row["p_value"] == pytest.approx(0.0024, abs=1e-4)
    assert row["significance"] == "**"


def test_strength_words(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.45,), (0.7,)], "v double")
    words = [r[0] for r in df.select(stats.strength_word(F.col("v"), stats.SPEARMAN_CUTS)).collect()]
    assert words == ["weak", "moderate", "strong", "very strong"]


def test_junk_names_need_whole_words(spark):
    rows = [(i, i % 5, f"n{i % 7}", f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id long, id long, label string, remark string")
    facts = {f.column: f for f in column_facts(df)}
    assert not stats.is_junk(facts["customer_id"]) and stats.is_junk(facts["customer_id"], "token")
    assert stats.is_junk(facts["id"]) and stats.is_junk(facts["remark"]) and not stats.is_junk(facts["label"])
    plan = stats.plan_tests(list(facts.values()))
    assert plan.numeric == ["customer_id"] and plan.categorical == ["label"] and plan.alpha == 0.05


def test_pps_step_and_noise(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 1, 1000)
    rows = [(float(a), 10.0 if a > 0.5 else 1.0, "hi" if a > 0.3 else "lo", float(n)) for a, n in zip(x, rng.normal(0, 1, 1000))]
    df = spark.createDataFrame(rows, "x double, step double, label string, noise double")
    scores = {(r["x"], r["y"]): r for r in pps.pps_matrix(df).collect()}
    assert len(scores) == 12
    assert scores[("x", "step")]["ppscore"] > 0.95 and scores[("x", "label")]["ppscore"] > 0.95
    assert scores[("noise", "step")]["ppscore"] < 0.1 and scores[("noise", "label")]["ppscore"] < 0.1
    assert scores[("x", "label")]["baseline_score"] == pytest.approx(0.7, abs=0.05)
    assert scores[("label", "step")]["case"] == "categorical_to_numeric"
    assert all(0 <= r["ppscore"] <= 1 for r in scores.values())


@pytest.mark.parametrize("rows, case", [(9, "insufficient_data"), (15, "numeric_to_numeric")])
def test_pps_needs_rows(spark, rows, case):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(rows)], "a double, b double")
    row = pps.pps_matrix(df).first()
    assert row["ppscore"] == 0.0 and row["case"] == case


def test_pps_sample_is_repeatable_and_bounded(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    a = pps.sampled(lines, ["l_quantity", "l_tax"], 100)
    assert a.count() == 100
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, pps.sampled(lines.repartition(7), ["l_quantity", "l_tax"], 100).collect()))


def test_stratified_folds_keep_shares():
    y = np.array([0] * 50 + [1] * 25 + [2] * 10)
    folds = pps._stratified(y, 5)
    for k in range(5):
        assert np.bincount(y[folds == k]).tolist() == [10, 5, 2]


def test_hierarchy_needs_a_value_everywhere(spark):
    rows = [("paris", "idf", "fr"), ("lyon", "ara", "fr"), ("nice", "paca", "fr"), ("rome", None, "it"), ("paris", "idf", "fr")]
    df = spark.createDataFrame(rows, "city string, area string, land string")
    found = {(r["col_a"], r["col_b"]) for r in relations.hierarchies(df, ["city", "area", "land"]).collect()}
    # Rome has no area, so city does not determine it.
    assert found == {("city", "land"), ("area", "land")}


def test_merge_is_symmetric_in_pairs(spark):
    one = spark.createDataFrame([("a", "b", "predictive", 0.4, "d", "m", "i")], relations.SCHEMA)
    two = spark.createDataFrame([("b", "a", "correlation", 0.9, "d", "m", "i"), ("c", "a", "correlation", 0.8, "d", "m", "i")], relations.SCHEMA)
    first = [(r["type"], r["strength"]) for r in relations.merge_relationships(one, two).collect()]
    assert first == [("correlation", 0.8), ("predictive", 0.4)]
    later = [(r["type"], r["strength"]) for r in relations.merge_relationships(one, two, later_wins=True).collect()]
    assert later == [("correlation", 0.9), ("correlation", 0.8)]


def test_kruskal_counts_each_number_once(spark):
    # Gaps in either column, a group of one row, a category with two labels, ties: against ranks taken per pair.
    rows = [(["a", "b", "c", None][i % 4], "xy"[i % 2] if i else "lone", float(i * i % 23) if i % 7 else None, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, h string, v double, w double")
    pairs = [("g", "v"), ("h", "v"), ("g", "w"), ("h", "w")]
    frame = df.toPandas()
    found = {(r.col_a, r.col_b): r for r in stats.kruskal_pairs(df, pairs).collect()}
    assert found.keys() == set(pairs)
    for a, b in pairs:
        part = frame[[a, b]].dropna()
        groups = [x for _, x in part.groupby(a)[b] if len(x) > 1]
        ranks = pd.concat(groups).rank()
        n, t = len(ranks), pd.concat(groups).value_counts()
        h = 12 / (n * (n + 1)) * sum(ranks[g.index].sum() ** 2 / len(g) for g in groups) - 3 * (n + 1)
        assert found[a, b].groups == len(groups)
        assert found[a, b].statistic == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))
    # The table of a number is counted for all its categories together: no row is copied for each of them before it is shuffled.
    sums = stats._rank_sums(df, "v", {0: "g", 1: "h"}, stats._group_cells(df, pairs, True).groupBy("pair", "a").count().withColumnRenamed("count", "size"), set(), Scale())
    plan = sums[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Join")
