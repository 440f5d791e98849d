import datetime

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions import dates, numbers, text
from tallyfold.operators import clean as C
from tallyfold.operators import merge, profile, scan, validate
from tallyfold.plans.scale import Scale

TINY = Scale(chunk_rows=9, bins=8)


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize("share, converted", [(79, False), (80, True), (81, True)])
def test_number_rate_boundary(spark, share, converted):
    df = spark.createDataFrame([(str(i) if i < share else "x",) for i in range(100)], "a string")
    assert (C.fit_types(df).numbers == ["a"]) == converted


def test_number_text_guard(spark):
    df = spark.createDataFrame([("12d",), (" 12 ",), ("1,5",), ("NaN",), ("-.5e3",), ("7.",)], "b string")
    got = values(df.select(numbers.text_to_number(F.col("b")).alias("v")), "v")
    assert got == [None, 12.0, None, None, -500.0, 7.0]


@pytest.mark.parametrize("share, converted", [(29, False), (30, True)])
def test_date_rate_boundary(spark, share, converted):
    df = spark.createDataFrame([("2024-03-05" if i < share else "word",) for i in range(100)], "d string")
    assert (C.fit_types(df).dates == ["d"]) == converted


@pytest.mark.parametrize("unclear, ambiguous", [(4, False), (6, True)])
def test_ambiguous_dates(spark, unclear, ambiguous):
    rows = [("03/04/2024" if i < unclear else "25/12/2024",) for i in range(100)]
    df = spark.createDataFrame(rows, "d string")
    plan = C.fit_types(df)
    assert (plan.ambiguous == ["d"]) == ambiguous and (plan.dates == ["d"]) != ambiguous
    # A given format settles the order and is used.
    fixed = C.fit_types(df, date_format="%d/%m/%Y")
    parsed = values(C.apply_types(df, fixed), "d")
    assert parsed[0] == datetime.datetime(2024, 4, 3)


@pytest.mark.parametrize(
    "written, month_first",
    [
        ("2024-01-02", (2024, 1, 2)), ("2024-1-2 03:04", (2024, 1, 2, 3, 4)), ("2024-01-02T03:04:05.5", (2024, 1, 2, 3, 4, 5, 500000)),
        ("2024/01/02", (2024, 1, 2)), ("20240102", (2024, 1, 2)), ("2 Jan 2024", (2024, 1, 2)), ("January 2, 2024", (2024, 1, 2)),
        ("01/02/2024", (2024, 1, 2)), ("13/02/2024", (2024, 2, 13)), ("1.2.2024", (2024, 1, 2)), ("02/30/2024", None), ("hello 12", None),
    ],
)
def test_date_texts(spark, written, month_first):
    df = spark.createDataFrame([(written,)], "d string")
    got = df.select(dates.parse_date(F.col("d")).alias("v")).first()["v"]
    assert got == (datetime.datetime(*month_first) if month_first else None)


def test_strftime_patterns():
    assert dates.java_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_tokens_and_extra_tokens(spark):
    df = spark.createDataFrame([(" N/A ",), ("-",), ("x",), (None,), ("Missing",)], "s string")
    assert values(C.null_tokens(df), "s") == [None, None, "x", None, "Missing"]
    assert values(C.null_tokens(df, {"s": {"missing_tokens": ["missing"]}}), "s") == [None, None, "x", None, None]


def test_fill_leaves_outliers_out(spark):
    rows = [(1.0, False), (2.0, False), (3.0, False), (1000.0, True), (None, False)]
    df = spark.createDataFrame(rows, "v double, v_outlier boolean")
    assert values(C.fill_missing(df, "mean"), "v")[-1] == 2.0
    assert values(C.fill_missing(df, "auto"), "v")[-1] == 2.0


def test_fill_drop_rule_runs_in_column_order(spark):
    rows = [(1.0, "k", 5.0), (None, "k", 7.0), (3.0, None, None), (9.0, "j", 100.0), (5.0, "k", None)]
    df = spark.createDataFrame(rows, "a double, b string, c double")
    out = C.fill_missing(df, column_rules={"b": {"impute": "drop"}, "c": {"impute": "mean"}})
    # a: median over all rows; the row without b goes; c: mean over the rows left.
    assert values(out, "a") == [1.0, 4.0, 9.0, 5.0]
    assert values(out, "c")[-1] == pytest.approx((5 + 7 + 100) / 3)


def test_constant_fill_defaults(spark):
    df = spark.createDataFrame([(None, None), (1.0, "x")], "v double, s string")
    out = C.fill_missing(df, "constant", "bad number").collect()[0]
    assert out["v"] == 0.0 and out["s"] == "bad number"
    assert C.fill_missing(df, "constant").collect()[0]["s"] == "Unknown"


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_interpolate_like_pandas(spark, scale):
    frame = pd.DataFrame({"g": ["hot"] * 60 + ["b"] * 20, "t": range(80)})
    frame["v"] = [None if i % 7 in (0, 1, 5) or i >= 57 else float(i * i % 31) for i in range(80)]
    frame["s"] = [None if i % 3 else f"s{i}" for i in range(80)]
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "g string, t long, v double, s string")
    got = C.interpolate(df, ["t"], ["g"], scale).toPandas().sort_values("t").reset_index(drop=True)
    for _, part in frame.groupby("g"):
        numeric = part.v.interpolate().ffill().bfill()
        pd.testing.assert_series_equal(got.v[part.index], numeric, check_names=False)
        texts = part.s.ffill().bfill()
        assert got.s[part.index].tolist() == texts.tolist()


def test_dedup_best_first_last(spark):
    rows = [(1, " A ", None, 5), (2, "a", "x", 5), (3, "A", "y", 5), (4, "b", None, None), (5, "B", None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c int")
    keep = lambda how: sorted(r["id"] for r in C.remove_duplicates(df, ["id"], ["a", "c"], how).collect())
    assert keep("best") == [2, 4] and keep("first") == [1, 4] and keep("last") == [3, 5]
    raw = C.remove_duplicates(df, ["id"], ["a", "c"], "first", normalize_text=False)
    assert raw.count() == 5


words = st.lists(st.tuples(st.sampled_from(["a", " A", "b  c", "B c", "NA", " ", "?", None]), st.sampled_from([1.0, 2.0, None])), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words)
def test_cleaning_twice_changes_nothing(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, s string, v double")
    once = C.null_tokens(C.clean_text(df, True))
    once = C.remove_duplicates(once, ["row"], ["s", "v"])
    twice = C.remove_duplicates(C.null_tokens(C.clean_text(once, True)), ["row"], ["s", "v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_clean_report(spark):
    rows = [(i, " N/A " if i == 3 else f" t{i % 4} ", str(i * 10), -5.0 if i == 7 else float(i + 1)) for i in range(20)]
    rows.append((20, "t1", "10", 2.0))
    rows.append((20, "t1", "10", 2.0))
    df = spark.createDataFrame(rows, "id int, label string, code string, price double")
    out, report = C.clean(df, C.Profile(duplicate_subset=["label", "code", "price"]), ["id"])
    assert report["rows_before"] == 22 and report["rows_after"] == out.count()
    assert report["duplicates_removed"] == 22 - out.count() > 0
    assert report["changes"]["missing_tokens"] == {"label": 1}
    assert report["changes"]["types"]["numbers"] == ["code"]
    assert report["changes"]["outliers"]["by_column"]["price"] >= 1 and "price_outlier" in report["columns_added"]
    assert out.filter("label is null").count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert profile.missing_by_column(df).first()["missing"] == 2
    assert profile.numeric_summary(df).first()["mean"] == 1.0


def test_french_names_fold():
    assert text.folded_name("Quantité") == "quantite" and text.folded_name("Prix_Unitaire ") == "prix_unitaire"


def test_scan_counts_equal_cells(spark):
    rows = [(i, None if i % 5 == 0 else f"v{i % 3}", "-" if i == 4 else "ok") for i in range(30)]
    df = spark.createDataFrame(rows, "row int, a string, b string")
    issues = {r["issue_type"]: r["issues"] for r in scan.scan_summary(scan.scan(df, "row")).collect()}
    distinct = len({r[1:] for r in rows})
    assert issues == {"missing": 6, "missing_token": 1, "duplicate": 30 - distinct}


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_scan_duplicates_of_a_hot_group(spark, scale):
    rows = [(i, "same" if i % 3 == 0 else f"u{i // 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "row int, a string")
    got = {r["row_key"]: r["description"] for r in scan.duplicate_rows(df, "row", scale=scale).collect()}
    first = {}
    want = {}
    for i, a in rows:
        if a in first:
            want[i] = f"Same as row {first[a]}"
        first.setdefault(a, i)
    assert got == want


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_outer_merge_matches_null_keys(spark, scale):
    a = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (3, None, 30), (None, None, 40)], "k int, j string, p int")
    b = spark.createDataFrame([(1, "x", 7), (None, "y", 8), (9, "z", 9), (None, None, 6)], "k int, j string, q int")
    got = {(r["k"], r["j"], r["p"], r["q"]) for r in merge.outer_merge(a, b).collect()}
    assert got == {(1, "x", 10, 7), (None, "y", 20, 8), (3, None, 30, None), (9, "z", None, 9), (None, None, 40, 6)}
    assert merge.outer_merge(a, spark.createDataFrame([(1,)], "other int")) is None


def test_validation_report(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, None, "c"), (900, 5, "c")], "a int, b int, c string")
    report = validate.validate(df, {"required_columns": ["a", "z"], "min_rows": 5, "column_types": {"a": "string"}, "value_ranges": {"a": (0, 100)}})
    assert not report["valid"] and len(report["errors"]) == 3
    assert "b is 66.7% missing" in report["warnings"] and "c has a single value" in report["warnings"]
    assert "a: 1 values out of range" in report["warnings"]
    assert not validate.validate(df.limit(0))["valid"]


def test_fact_numbers(spark):
    df = spark.createDataFrame([(1234567.0,), (1234.5,), (12.5,), (3.0,), (None,), (-0.25,)], "v double")
    got = values(df.select(numbers.fact_number(F.col("v")).alias("t")), "t")
    assert got == ["1,234,567", "1,234.50", "12.5", "3", "n/a", "-0.25"]
    short = values(df.select(numbers.short_number(F.col("v")).alias("t")), "t")
    assert short == ["1.23M", "1.23K", "12.50", "3.00", "N/A", "-0.25"]


def test_each_text_is_parsed_once(spark):
    rows = [(f"2024-01-{1 + i % 20:02d}T05:06:07+02:00", "03/04/2024 3:04 AM", "x" * 70) for i in range(60)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    rates = C._type_rates(df, df.columns, None)
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    # The shape of a text is worked out in one place, of the texts that are counted and not of the rows below.
    below = plan[plan.rindex("Aggregate [i") :].split("\n", 1)[1]
    assert plan.count("mask(") == 1 and "mask(" not in below
    found = {r["i"]: (r["num"], r["date"], r["diff"]) for r in rates.collect()}
    assert found == {0: (0.0, 1.0, 0.0), 1: (0.0, 1.0, 1.0), 2: (0.0, 0.0, None)}


@pytest.mark.parametrize(
    "written, instant",
    [
        ("2024-01-02 05:06:07 -0130", (2024, 1, 2, 6, 36, 7)), ("2024-01-02T05:06:07.25 Z", (2024, 1, 2, 5, 6, 7, 250000)), ("2024-01-02T05:06:07+0200", (2024, 1, 2, 3, 6, 7)),
        ("2024-1-2 3:04 PM", (2024, 1, 2, 15, 4)), ("02-jan-2024", (2024, 1, 2)), ("2/1/24", (2024, 2, 1)), ("13.02.2024", (2024, 2, 13)), ("2024/01/02\n", None), ("2024-01-02 -0130", None),
    ],
)
def test_zones_and_shapes(spark, written, instant):
    df = spark.createDataFrame([(written,)], "d string")
    got = df.select(dates.parse_date(F.col("d")).alias("v"), dates.date_facts(F.col("d"))["dated"].alias("dated")).first()
    assert got["v"] == (datetime.datetime(*instant) if instant else None) and got["dated"] == (instant is not None)
