"""Statistical relationships between columns: Pearson, Spearman, Kruskal-Wallis, chi-square, ANOVA.

All pairs of one kind are tested in one job over pair-wise counts or column ranks; only one row per pair
gets a p-value. Ranks come from value/count tables, so raw rows are never sorted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numbers import number
from tallyfold.functions.special import chi2_p, f_p, t_p
from tallyfold.operators.merge import merge_all
from tallyfold.operators.relations import NAMES
from tallyfold.operators.roles import ColumnFacts, category, column_facts, is_noise
from tallyfold.operators.tools import correlations
from tallyfold.plans import names as N
from tallyfold.plans.ordering import attach, average_ranks, running_sums
from tallyfold.plans.scale import DEFAULT, Scale, row_count
from tallyfold.session import stored

# Cut-offs of the strength words, and the least effect that is reported.
SPEARMAN_CUTS = (0.25, 0.45, 0.70)
ETA_CUTS = (0.01, 0.06, 0.14)
CRAMER_CUTS = (0.10, 0.25, 0.40)
PEARSON_LEAST = 0.5
PLAIN_CRAMER_LEAST = 0.10
ANOVA_LEAST = 0.06
PLAIN_ALPHA = 0.05


def strength_word(value: Column, cuts: tuple[float, float, float]) -> Column:
    low, middle, high = cuts
    return (
        F.when(value >= high, "very strong").when(value >= middle, "strong").when(value >= low, "moderate").otherwise("weak")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def _pair_map(pairs: list[tuple[str, str]]) -> Column:
    entries = [
        x for i, (a, b) in enumerate(pairs) for x in (F.lit(i), F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")))
    ]
    return F.create_map(*entries)[F.col("pair")]


def _named(df: DataFrame, pairs: list[tuple[str, str]], fields: list[str]) -> DataFrame:
    name = _pair_map(pairs)
    return df.select(name["col_a"].alias("col_a"), name["col_b"].alias("col_b"), *fields)


def is_junk(f: ColumnFacts, match: str = "joined") -> bool:
    """Identifier-like or free text. By default separators are removed before whole words are compared, so
    ``customer_id`` is not caught; ``match='token'`` compares its parts."""
    name = re.sub(r"[_\-\s]", "" if match == "joined" else " ", f.column)
    if re.search(N.JUNK_NAME, name, re.IGNORECASE):
        return True
    present = max(f.rows - f.missing, 1)
    return f.kind == "text" and f.distinct / present > 0.9


@dataclass(frozen=True)
class TestPlan:
    """Columns worth testing and the significance level for that many tests."""

    numeric: list[str]
    categorical: list[str]
    tests: int
    alpha: float


def plan_tests(facts: list[ColumnFacts], match: str = "joined", drop_constant: bool = False) -> TestPlan:
    rows = facts[0].rows if facts else 0
    kept = [f for f in facts if not is_junk(f, match) and not (drop_constant and f.distinct <= 1)]
    numeric = [f.column for f in kept if f.numeric]
    most = 50 if rows >= 30 else float("inf")
    categorical = [f.column for f in kept if not f.numeric and 2 <= f.distinct <= most]
    a, b = len(numeric), len(categorical)
    tests = a * (a - 1) // 2 + a * b + b * (b - 1) // 2
    return TestPlan(numeric, categorical, tests, 0.10 if rows < 30 else 0.05 / max(tests, 1))


def pearson_pairs(df: DataFrame, columns: list[str], least: float = PEARSON_LEAST) -> DataFrame:
    """Pairs with |r| above the limit."""
    found = correlations(df, columns).filter(F.col("r").isNotNull() & (F.abs("r") > least))
    rank = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return found.filter(rank[F.col("x")] < rank[F.col("y")]).select(
        F.col("x").alias("col_a"),
        F.col("y").alias("col_b"),
        F.lit("correlation").alias("type"),
        F.round(F.abs("r"), 3).alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
        F.lit("pearson").alias("method"),
        F.lit(None).cast("string").alias("insight"),
    )


def column_ranks(df: DataFrame, value: Column, rows: int, scale: Scale = DEFAULT) -> DataFrame:
    """``(value, n, avg_rank)`` of one expression."""
    freq = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # Several chunks read the table for their cuts, their totals and their rows: it is counted once.
    return average_ranks(freq if scale.chunks(rows) == 1 else stored(freq), [], rows, scale)


def spearman_rho(df: DataFrame, columns: list[str], rows: int | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """``(col_a, col_b, rho)`` of all pairs.

    Columns without gaps are ranked once and all their pairs share one aggregate. A pair with gaps is
    ranked on its own complete rows, as the definition asks."""
    rows = row_count(df) if rows is None else rows
    cells = {c: number(df, c) for c in columns}
    present = df.agg(*[F.count(cells[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    whole = [c for i, c in enumerate(columns) if present[f"n{i}"] == rows]
    pairs = list(combinations(columns, 2))
    together = [(a, b) for a, b in pairs if a in whole and b in whole]
    parts = []
    if together:
        used = [c for c in whole if any(c in p for p in together)]
        parts.append(_rank_correlations(df, cells, used, together, rows, scale))
    for a, b in pairs:
        if (a, b) not in together:
            complete = df.filter(cells[a].isNotNull() & cells[b].isNotNull())
            parts.append(_rank_correlations(complete, cells, [a, b], [(a, b)], rows, scale))
    return reduce(DataFrame.unionByName, parts)


def _rank_correlations(df, cells, columns, pairs, rows, scale) -> DataFrame:
    # Ranks come from the source each, not from the joins before, so the plan grows with the columns and no faster.
    base = df.select(*[cells[c].alias(f"v{i}") for i, c in enumerate(columns)])
    ranked = base
    for i, _ in enumerate(columns):
        facts = column_ranks(base, F.col(f"v{i}"), rows, scale).select(
            F.col("value").alias(f"v{i}"), F.col("n").alias("_n"), F.col("avg_rank").alias(f"r{i}")
        )
        ranked = attach(ranked, facts, [f"v{i}"]).drop("_n", f"v{i}")
    at = {c: i for i, c in enumerate(columns)}
    wide = ranked.agg(*[F.corr(f"r{at[a]}", f"r{at[b]}").alias(f"rho{i}") for i, (a, b) in enumerate(pairs)])
    rows_ = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"rho{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows_)))


def spearman_pairs(df: DataFrame, columns: list[str], rows: int | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """Rho with its t statistic (degrees of freedom from all rows) and two-sided p."""
    rows = row_count(df) if rows is None else rows
    t = F.col("rho") * F.sqrt(F.lit(float(rows - 2)) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-10)))
    tested = spearman_rho(df, columns, rows, scale).filter(F.col("rho").isNotNull() & ~F.isnan("rho"))
    return tested.withColumn("statistic", t).withColumn("p_value", t_p("statistic", F.lit(float(rows - 2))))


def _group_cells(df: DataFrame, pairs: list[tuple[str, str]], numeric: bool) -> DataFrame:
    """``(pair, a, b)`` rows of the complete cells of every pair."""
    cells = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(f"`{a}`").cast("string").alias("a"),
            (number(df, b) if numeric else F.col(f"`{b}`").cast("string")).alias("b"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return df.select(F.inline(F.array(*cells))).filter("a is not null and b is not null")


def group_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair: rows, groups, sums of squares between, within and total, over all complete rows.

    Two aggregate levels: per group count, mean and variance, then their combination around the grand mean."""
    groups = (
        _group_cells(df, pairs, True)
        .groupBy("pair", "a")
        .agg(F.count("b").alias("n"), F.avg("b").alias("mean"), F.var_pop("b").alias("var"))
    )
    return combine_groups(groups)


def combine_groups(groups: DataFrame) -> DataFrame:
    """Sums of squares from group moments, around the grand mean, so nothing large is subtracted from
    something large."""
    grand = groups.groupBy("pair").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    # One row per pair.
    return (
        groups.join(F.broadcast(grand), "pair")
        .groupBy("pair")
        .agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ss_between"),
            F.sum(F.col("n") * F.col("var")).alias("ss_within"),
        )
        .withColumn("ss_total", F.col("ss_between") + F.col("ss_within"))
    )


def eta_squared(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of the numeric column's variance explained by the category."""
    eta = F.when(F.col("ss_total") > 0, F.col("ss_between") / F.col("ss_total")).otherwise(0.0)
    return _named(group_sums(df, pairs).withColumn("eta_squared", eta), pairs, ["rows", "eta_squared"])


def kruskal_pairs(
    df: DataFrame, pairs: list[tuple[str, str]], rows: int | None = None, scale: Scale = DEFAULT
) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H, its p-value and eta² per (category, number) pair.

    Groups need two rows, pairs two groups and enough complete rows. All categories of a number share one table of its values with their
    labels, counted once; hot values are single rows there, and the ranks of all pairs are running sums of one pass over it."""
    rows = row_count(df) if rows is None else rows
    sizes = stored(_group_cells(df, pairs, True).groupBy("pair", "a").agg(F.count(F.lit(1)).alias("size")))
    # One row per pair with groups of a single row.
    lone = {r["pair"] for r in sizes.filter("size = 1").select("pair").distinct().collect()}
    parts = []
    for b in dict.fromkeys(b for _, b in pairs):
        own = {i: a for i, (a, other) in enumerate(pairs) if other == b}
        parts.append(_rank_sums(df, b, own, sizes, lone, scale))
    group_ranks, ties = (reduce(DataFrame.unionByName, x) for x in zip(*parts))
    total = F.col("total").cast("double")
    spread = group_ranks.groupBy("pair").agg(
        F.sum(F.pow("rank_sum", 2) / F.col("size")).alias("_ranks"), F.count(F.lit(1)).alias("groups")
    )
    complete = sizes.groupBy("pair").agg(F.sum("size").alias("complete_rows"))
    h = F.lit(12.0) / (total * (total + 1)) * F.col("_ranks") - 3 * (total + 1)
    correction = 1 - F.col("tie_sum") / (F.pow(total, F.lit(3.0)) - total)
    tested = (
        spread.join(ties, "pair")
        .join(complete, "pair")
        .filter((F.col("groups") >= 2) & (F.col("complete_rows") >= max(5, rows // 10)))
        .withColumn("statistic", F.when(correction > 0, h / correction))
        .withColumn("p_value", chi2_p("statistic", (F.col("groups") - 1).cast("double")))
    )
    named = _named(tested, pairs, ["groups", "statistic", "p_value"])
    return named.join(eta_squared(df, pairs).drop("rows"), ["col_a", "col_b"])


def _rank_sums(
    df: DataFrame, number_column: str, own: dict[int, str], sizes: DataFrame, lone: set[int], scale: Scale
) -> tuple[DataFrame, DataFrame]:
    """Of one number and its categories, by pair: ``(pair, a, rank_sum, size)`` of groups of two rows and more, each ranked among
    the rows of such groups, and ``(pair, total, tie_sum)``."""
    labels = [F.col(f"`{a}`").cast("string").alias(f"a{i}") for i, a in own.items()]
    cells = df.select(number(df, number_column).alias("value"), *labels).filter("value is not null")
    counted = cells.groupBy("value", *[f"a{i}" for i in own]).agg(F.count(F.lit(1)).alias("n"))
    for i in lone.intersection(own):
        single = sizes.filter((F.col("pair") == i) & (F.col("size") == 1)).select(F.col("a").alias(f"a{i}"), F.lit(True).alias("_lone"))
        counted = counted.join(single, f"a{i}", "left").withColumn(f"a{i}", F.when(F.col("_lone").isNull(), F.col(f"a{i}"))).drop("_lone")
    counted = stored(counted)
    used = {f"n{i}": F.sum(F.when(F.col(f"a{i}").isNotNull(), F.col("n")).otherwise(0)).alias(f"n{i}") for i in own}
    values = stored(counted.groupBy("value").agg(*used.values()))
    ranks = running_sums(values, [], ["value"], {f"r{i}": F.col(f"n{i}") for i in own}, row_count(values), scale)
    ranks = ranks.select(F.col("value"), *[(F.col(f"r{i}") + (F.col(f"n{i}") + 1) / F.lit(2.0)).alias(f"r{i}") for i in own])
    ranked = attach(counted, ranks, ["value"])
    rows = [F.struct(F.lit(i).alias("pair"), F.col(f"a{i}").alias("a"), F.col(f"r{i}").alias("avg_rank"), F.col("n").alias("n")) for i in own]
    group_ranks = (
        ranked.select(F.inline(F.array(*rows)))
        .filter("a is not null")
        .groupBy("pair", "a")
        .agg(F.sum(F.col("avg_rank") * F.col("n")).alias("rank_sum"), F.sum("n").alias("size"))
    )
    cubes = values.agg(
        *[F.sum(f"n{i}").alias(f"t{i}") for i in own],
        *[F.sum(F.pow(F.col(f"n{i}").cast("double"), 3) - F.col(f"n{i}")).alias(f"c{i}") for i in own],
    )
    totals = [F.struct(F.lit(i).alias("pair"), F.col(f"t{i}").alias("total"), F.col(f"c{i}").alias("tie_sum")) for i in own]
    return group_ranks, cubes.select(F.inline(F.array(*totals)))


def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair: rows, table size, chi² with and without Yates correction, least expected-free cell count.

    Only occurring cells are counted. An absent cell adds exactly its expected count, so all absent cells
    together add rows − Σ expected; no empty cells are generated. Margins are windows over counted cells;
    the columns that ``plan_tests`` admits have at most fifty labels, so a pair has at most 2500 of them."""
    cells = _group_cells(df, pairs, False).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *k: Window.partitionBy(*k)
    margins = cells.select(
        "pair",
        "a",
        "b",
        F.col("n").cast("double").alias("n"),
        F.sum("n").over(by("pair", "a")).cast("double").alias("row_sum"),
        F.sum("n").over(by("pair", "b")).cast("double").alias("col_sum"),
        F.sum("n").over(by("pair")).cast("double").alias("total"),
    )
    expected = F.col("row_sum") * F.col("col_sum") / F.col("total")
    gap = F.abs(F.col("n") - F.col("e"))
    yates = F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("e")
    summed = (
        margins.withColumn("e", expected)
        .groupBy("pair")
        .agg(
            F.max("total").alias("rows"),
            F.count_distinct("a").alias("r"),
            F.count_distinct("b").alias("k"),
            F.count(F.lit(1)).alias("cells"),
            F.min("n").alias("least_cell"),
            F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("_seen"),
            F.sum("e").alias("_expected"),
            F.sum(yates).alias("_yates"),
        )
    )
    absent = F.greatest(F.col("rows") - F.col("_expected"), F.lit(0.0))
    chi2 = F.col("_seen") + absent
    # In a 2×2 table one cell, or two equal-sized diagonal shares, can be absent.
    two_absent = F.when(F.col("cells") == 2, 2.0).otherwise(1.0)
    each = absent / two_absent
    yates_absent = F.when(absent > 1e-12, two_absent * F.pow(each - F.least(F.lit(0.5), each), 2) / each).otherwise(0.0)
    square = (F.col("r") == 2) & (F.col("k") == 2)
    return (
        summed.withColumn("chi2", chi2)
        .withColumn("chi2_yates", F.when(square, F.col("_yates") + yates_absent).otherwise(chi2))
        .withColumn("degrees", ((F.col("r") - 1) * (F.col("k") - 1)).cast("double"))
        .withColumn("least_cell", F.when(F.col("cells") < F.col("r") * F.col("k"), 0.0).otherwise(F.col("least_cell")))
        .drop("_seen", "_expected", "_yates")
    )


def corrected_cramers_v() -> Column:
    """Bias-corrected V over the fields of ``contingency``."""
    n, r, k = F.col("rows"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    side = F.least(r - F.pow(r - 1, F.lit(2.0)) / (n - 1), k - F.pow(k - 1, F.lit(2.0)) / (n - 1)) - 1
    return F.when(side <= 0, F.lit(0.0)).otherwise(F.sqrt(phi2 / side))


def plain_cramers_v() -> Column:
    side = F.least(F.col("r"), F.col("k")) - 1
    return F.when(side > 0, F.sqrt(F.col("chi2") / (F.col("rows") * side))).otherwise(0.0)


def chi_square_pairs(df: DataFrame, pairs: list[tuple[str, str]], rows: int | None = None) -> DataFrame:
    """Chi² (Yates on 2×2), p and bias-corrected V (never Yates) of every pair with enough rows."""
    rows = row_count(df) if rows is None else rows
    tested = (
        contingency(df, pairs)
        .filter((F.col("rows") >= max(5, rows // 10)) & (F.col("r") >= 2) & (F.col("k") >= 2))
        .withColumn("statistic", F.col("chi2_yates"))
        .withColumn("p_value", chi2_p("chi2_yates", "degrees"))
        .withColumn("cramers_v", corrected_cramers_v())
    )
    return _named(tested, pairs, ["rows", "degrees", "statistic", "p_value", "cramers_v"])


def plain_association_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Uncorrected chi² and V; tables with a cell below five are skipped."""
    tested = (
        contingency(df, pairs)
        .filter((F.col("least_cell") >= 5) & (F.col("r") >= 2) & (F.col("k") >= 2))
        .withColumn("statistic", F.col("chi2"))
        .withColumn("p_value", chi2_p("chi2", "degrees"))
        .withColumn("cramers_v", plain_cramers_v())
        .withColumn("significance", stars(F.col("p_value")))
    )
    return _named(tested, pairs, ["degrees", "statistic", "p_value", "cramers_v", "significance"])


def anova_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One-way F with p over groups of two rows and more, and eta² as the share of sums of squares."""
    groups = (
        _group_cells(df, pairs, True)
        .groupBy("pair", "a")
        .agg(F.count("b").alias("n"), F.avg("b").alias("mean"), F.var_pop("b").alias("var"))
        .filter("n >= 2")
    )
    between, within = F.col("groups") - 1, F.col("rows") - F.col("groups")
    f = (F.col("ss_between") / between) / (F.col("ss_within") / within)
    tested = (
        combine_groups(groups)
        .filter((F.col("groups") >= 2) & (F.col("rows") > F.col("groups")))
        .withColumn("statistic", F.when(F.col("ss_within") > 0, f))
        .withColumn("p_value", f_p("statistic", between.cast("double"), within.cast("double")))
        .withColumn("eta_squared", F.when(F.col("ss_total") > 0, F.col("ss_between") / F.col("ss_total")).otherwise(0.0))
        .withColumn("significance", stars(F.col("p_value")))
    )
    return _named(tested, pairs, ["groups", "statistic", "p_value", "eta_squared", "significance"])


RELATIONSHIP = [*NAMES, "p_value", "statistic", "strength_label"]


def _empty(df: DataFrame) -> DataFrame:
    schema = "col_a string, col_b string, type string, strength double, direction string, method string, insight string, p_value double, statistic double, strength_label string"
    return df.sparkSession.createDataFrame([], schema)


def significant_spearman(df: DataFrame, columns: list[str], alpha: float, rows: int, scale: Scale = DEFAULT) -> DataFrame:
    size = F.abs("rho")
    kept = spearman_pairs(df, columns, rows, scale).filter((F.col("p_value") < alpha) & (size >= SPEARMAN_CUTS[0]))
    word = strength_word(size, SPEARMAN_CUTS)
    sign = F.when(F.col("rho") > 0, "positive").otherwise("negative")
    return kept.select(
        "col_a", "col_b", F.lit("correlation").alias("type"), size.alias("strength"), sign.alias("direction"),
        F.lit("spearman").alias("method"),
        F.concat(word, F.lit(" "), sign, F.lit(" rank correlation")).alias("insight"),
        "p_value", "statistic", word.alias("strength_label"),
    )


def significant_kruskal(df: DataFrame, pairs: list[tuple[str, str]], alpha: float, rows: int, scale: Scale = DEFAULT) -> DataFrame:
    eta = F.col("eta_squared")
    kept = kruskal_pairs(df, pairs, rows, scale).filter((F.col("p_value") < alpha) & (eta >= ETA_CUTS[0]))
    text = F.format_string("eta squared %.3f of %s by groups of %s", eta, "col_b", "col_a")
    return kept.select(
        "col_a", "col_b", F.lit("categorical_to_numeric").alias("type"), eta.alias("strength"),
        F.concat("col_a", F.lit(" → "), "col_b").alias("direction"), F.lit("kruskal_wallis").alias("method"),
        text.alias("insight"), "p_value", "statistic", strength_word(eta, ETA_CUTS).alias("strength_label"),
    )


def significant_associations(df: DataFrame, pairs: list[tuple[str, str]], alpha: float, rows: int) -> DataFrame:
    v = F.col("cramers_v")
    kept = chi_square_pairs(df, pairs, rows).filter((F.col("p_value") < alpha) & (v >= CRAMER_CUTS[0]))
    text = F.format_string("V %.3f between labels of %s and %s", v, "col_a", "col_b")
    return kept.select(
        "col_a", "col_b", F.lit("categorical_association").alias("type"), v.alias("strength"),
        F.concat("col_a", F.lit(" ↔ "), "col_b").alias("direction"), F.lit("chi_square").alias("method"),
        text.alias("insight"), "p_value", "statistic", strength_word(v, CRAMER_CUTS).alias("strength_label"),
    )


def detect_relationships(df: DataFrame, facts: list[ColumnFacts] | None = None, scale: Scale = DEFAULT) -> DataFrame:
    """All significant relationships of a table, strongest first."""
    facts = facts or column_facts(df)
    plan = plan_tests(facts, drop_constant=True)
    rows = facts[0].rows
    parts = []
    if len(plan.numeric) > 1:
        parts.append(significant_spearman(df, plan.numeric, plan.alpha, rows, scale))
    if plan.numeric and plan.categorical:
        mixed = [(c, n) for c in plan.categorical for n in plan.numeric]
        parts.append(significant_kruskal(df, mixed, plan.alpha, rows, scale))
    if len(plan.categorical) > 1:
        parts.append(significant_associations(df, list(combinations(plan.categorical, 2)), plan.alpha, rows))
    found = reduce(DataFrame.unionByName, parts) if parts else _empty(df)
    return found.orderBy(F.desc("strength"), "col_a", "col_b")


def relationship_sections(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("relationships"), F.max("strength").alias("strongest"))


def detect_across(tables: list[tuple[str, DataFrame]], scale: Scale = DEFAULT) -> DataFrame:
    """Relationships of each table and of their merge, labelled; a table named twice counts once."""
    first_seen: dict[str, DataFrame] = {}
    for name, table in tables:
        first_seen.setdefault(name, table)
    unique = list(first_seen.items())
    parts = [detect_relationships(d, scale=scale).withColumn("dataset", F.lit(n)) for n, d in unique]
    if len(unique) > 1:
        merged, _ = merge_all(unique, count_rows=False)
        # Every test reads the merge again; it is joined once.
        parts.append(detect_relationships(stored(merged), scale=scale).withColumn("dataset", F.lit("merged")))
    return reduce(DataFrame.unionByName, parts)


def pearson_candidates(facts: list[ColumnFacts]) -> list[str]:
    """Numeric columns that are neither identifiers nor noise."""
    return [f.column for f in facts if f.numeric and category(f) != "identifiers" and not is_noise(f)]
