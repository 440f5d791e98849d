"""Statistical relationships, predictive scores, hierarchies, full analysis."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyfold.catalog.base import Registry, longs, rounded, table
from tallyfold.operators import analyze, pps, relations, roles, stats

REG = Registry()

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABELS = ["l_returnflag", "l_linestatus"]
MIXED = [(c, n) for c in LABELS for n in NUMBERS]
ORDER_LABELS = ["o_orderstatus", "o_orderpriority"]


def linked(spark, folder):
    """Orders with dependent columns worked out of their key, so that associations exist."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        "CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'small' END AS size",
        "CASE WHEN o_totalprice > 300000 THEN 'yes' ELSE 'no' END AS rich",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'a' WHEN o_totalprice > 250000 THEN 'a' ELSE 'b' END AS half",
    )


LINKED = """o AS (SELECT *, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'small' END AS size,
  CASE WHEN o_totalprice > 300000 THEN 'yes' ELSE 'no' END AS rich,
  CASE WHEN o_orderkey % 4 = 0 THEN 'a' WHEN o_totalprice > 250000 THEN 'a' ELSE 'b' END AS half FROM orders)"""


PRICED = {
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "net": "l_extendedprice * (1 - l_discount)",
    "unsold": "60 - l_quantity",
}


@REG.add(
    "pearson_pairs",
    f"WITH t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in PRICED.items())} FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({a}, {b})), 3) AS strength,
        CASE WHEN corr({a}, {b}) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM t HAVING abs(corr({a}, {b})) > 0.5"""
        for a, b in combinations(PRICED, 2)
    ),
)
def pearson_pairs(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PRICED.items()])
    return stats.pearson_pairs(lines, list(PRICED)).select("col_a", "col_b", "strength", "direction")


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"


@REG.add(
    "spearman_pairs",
    f"WITH r AS (SELECT {', '.join(_rank(c) for c in NUMBERS)} FROM lineitem), n AS (SELECT count(*) AS n FROM lineitem), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(r_{a}, r_{b}) AS rho FROM r" for a, b in combinations(NUMBERS, 2))
    + ") SELECT col_a, col_b, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-10)), 3) AS statistic FROM p, n",
)
def spearman_pairs(spark, folder):
    found = stats.spearman_pairs(table(spark, folder, "lineitem"), NUMBERS)
    return rounded(found.select("col_a", "col_b", "rho", "statistic"), rho=6, statistic=3)


@REG.add(
    "spearman_with_gaps",
    """WITH e AS (SELECT user_id AS a, value AS b FROM events WHERE event_id % 3 <> 0), r AS (SELECT
         rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM e)
       SELECT 'user_id' AS col_a, 'value' AS col_b, round(corr(ra, rb), 6) AS rho FROM r""",
)
def spearman_with_gaps(spark, folder):
    gapped = table(spark, folder, "events").selectExpr("user_id", "CASE WHEN event_id % 3 <> 0 THEN value END AS value")
    return rounded(stats.spearman_rho(gapped, ["user_id", "value"]), rho=6)


def _kruskal_sql(a: str, b: str, source: str) -> str:
    return f"""(WITH t AS (SELECT {a} AS g, {b} AS v FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
      k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM t),
      s AS (SELECT g, sum(r) AS rs, count(*) AS n FROM k GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
      ties AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ts FROM (SELECT count(*) AS c FROM t GROUP BY v)),
      m AS (SELECT avg(v) AS mean, var_pop(v) * count(*) AS sst FROM t), e AS (SELECT sum(q) AS ssb FROM (SELECT count(*) * (avg(v) - max(mean)) ** 2 AS q FROM t, m GROUP BY g))
      SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(count(*) AS BIGINT) AS groups,
        round((12.0 / (max(n.n) * (max(n.n) + 1)) * sum(rs * rs / s.n) - 3 * (max(n.n) + 1)) / (1 - max(ts) / (max(n.n) ** 3 - max(n.n))), 4) AS statistic,
        round(max(ssb) / max(sst), 6) AS eta_squared FROM s, n, ties, m, e)"""


ORDER_MIXED = [("size", "o_totalprice"), ("o_orderpriority", "o_totalprice"), ("half", "o_totalprice")]


@REG.add("kruskal_pairs", f"WITH {LINKED} " + " UNION ALL ".join(f"SELECT * FROM {_kruskal_sql(a, b, 'o')}" for a, b in ORDER_MIXED))
def kruskal_pairs(spark, folder):
    found = stats.kruskal_pairs(linked(spark, folder), ORDER_MIXED)
    return rounded(longs(found, "groups").drop("p_value"), statistic=4, eta_squared=6)


@REG.add(
    "eta_squared",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS rows, round(sum((gm - m) ** 2) / sum(({b} - m) ** 2), 8) AS eta_squared
        FROM (SELECT {b}, avg({b}) OVER (PARTITION BY {a}) AS gm, avg({b}) OVER () AS m FROM lineitem)"""
        for a, b in MIXED
    ),
)
def eta_squared(spark, folder):
    return rounded(stats.eta_squared(table(spark, folder, "lineitem"), MIXED), eta_squared=8)


def _chi_sql(a: str, b: str, source: str) -> str:
    """All cells of the table, empty ones too, in the plain textbook way."""
    return f"""(WITH t AS (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
      ra AS (SELECT a, count(*) AS n FROM t GROUP BY 1), cb AS (SELECT b, count(*) AS n FROM t GROUP BY 1),
      cells AS (SELECT coalesce(o.n, 0) AS o, ra.n * cb.n / n.n AS e FROM ra CROSS JOIN cb CROSS JOIN n
        LEFT JOIN (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2) o ON o.a = ra.a AND o.b = cb.b)
      SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT n FROM n) AS rows, (SELECT CAST(count(*) AS DOUBLE) FROM ra) AS r, (SELECT CAST(count(*) AS DOUBLE) FROM cb) AS k,
        sum((o - e) ** 2 / e) AS chi2, sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) AS yates, min(o) AS least FROM cells)"""


CHI = [("size", "rich"), ("rich", "half"), ("o_orderstatus", "o_orderpriority"), ("size", "half")]
CHI_SQL = f"WITH {LINKED}, c AS (" + " UNION ALL ".join(f"SELECT * FROM {_chi_sql(a, b, 'o')}" for a, b in CHI) + ")"
CORRECTED = """CASE WHEN least(r - (r - 1) ** 2 / (rows - 1), k - (k - 1) ** 2 / (rows - 1)) - 1 <= 0 THEN 0
  ELSE sqrt(greatest(0, chi2 / rows - (k - 1) * (r - 1) / (rows - 1)) / (least(r - (r - 1) ** 2 / (rows - 1), k - (k - 1) ** 2 / (rows - 1)) - 1)) END"""


@REG.add(
    "chi_square_pairs",
    CHI_SQL + " SELECT col_a, col_b, rows, (r - 1) * (k - 1) AS degrees, round(CASE WHEN r = 2 AND k = 2 THEN yates ELSE chi2 END, 4) AS statistic FROM c",
)
def chi_square_pairs(spark, folder):
    found = stats.chi_square_pairs(linked(spark, folder), CHI)
    return rounded(found.select("col_a", "col_b", "rows", "degrees", "statistic"), statistic=4)


@REG.add("cramers_v_corrected", CHI_SQL + f" SELECT col_a, col_b, round({CORRECTED}, 6) AS cramers_v FROM c")
def cramers_v_corrected(spark, folder):
    found = stats.chi_square_pairs(linked(spark, folder), CHI)
    return rounded(found.select("col_a", "col_b", "cramers_v"), cramers_v=6)


@REG.add(
    "cramers_v_plain",
    CHI_SQL + " SELECT col_a, col_b, round(chi2, 4) AS statistic, round(sqrt(chi2 / (rows * (least(r, k) - 1))), 6) AS cramers_v FROM c WHERE least >= 5",
)
def cramers_v_plain(spark, folder):
    found = stats.plain_association_pairs(linked(spark, folder), CHI)
    return rounded(found.select("col_a", "col_b", "statistic", "cramers_v"), statistic=4, cramers_v=6)


@REG.add(
    "anova_pairs",
    f"WITH {LINKED}, g AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {a} AS g, {b} AS v, avg({b}) OVER (PARTITION BY {a}) AS gm, avg({b}) OVER () AS m FROM o" for a, b in ORDER_MIXED
    )
    + """), s AS (SELECT col_a, col_b, count(DISTINCT g) AS k, count(*) AS n, sum((gm - m) ** 2) AS ssb, sum((v - gm) ** 2) AS ssw FROM g GROUP BY 1, 2)
       SELECT col_a, col_b, k AS groups, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS statistic, round(ssb / (ssb + ssw), 6) AS eta_squared FROM s""",
)
def anova_pairs(spark, folder):
    found = stats.anova_pairs(linked(spark, folder), ORDER_MIXED)
    return rounded(found.select("col_a", "col_b", "groups", "statistic", "eta_squared"), statistic=4, eta_squared=6)


@REG.add(
    "stat_columns",
    """WITH f AS (SELECT 'p_partkey' AS c, 'n' AS k, count(DISTINCT p_partkey) AS d, count(*) AS n FROM part
        UNION ALL SELECT 'p_size', 'n', count(DISTINCT p_size), count(*) FROM part UNION ALL SELECT 'p_retailprice', 'n', count(DISTINCT p_retailprice), count(*) FROM part
        UNION ALL SELECT 'p_name', 't', count(DISTINCT p_name), count(*) FROM part UNION ALL SELECT 'p_brand', 't', count(DISTINCT p_brand), count(*) FROM part
        UNION ALL SELECT 'p_type', 't', count(DISTINCT p_type), count(*) FROM part),
       k AS (SELECT * FROM f WHERE NOT (k = 't' AND d / n > 0.9)), s AS (SELECT * FROM k WHERE k = 'n' OR d BETWEEN 2 AND 50),
       t AS (SELECT CAST(count(*) * (count(*) - 1) / 2 AS DOUBLE) AS tests FROM s)
       SELECT c AS "column", CASE k WHEN 'n' THEN 'numeric' ELSE 'categorical' END AS kind, round(0.05 / tests, 8) AS alpha FROM s, t""",
)
def stat_columns(spark, folder):
    plan = stats.plan_tests(roles.column_facts(table(spark, folder, "part"), ["p_partkey"]))
    rows = [(c, "numeric", round(plan.alpha, 8)) for c in plan.numeric]
    rows += [(c, "categorical", round(plan.alpha, 8)) for c in plan.categorical]
    return spark.createDataFrame(rows, "column string, kind string, alpha double")


@REG.add(
    "detect_relationships",
    f"""WITH {LINKED}, k AS (SELECT * FROM {_kruskal_sql("size", "o_totalprice", "o")} UNION ALL SELECT * FROM {_kruskal_sql("rich", "o_totalprice", "o")}
          UNION ALL SELECT * FROM {_kruskal_sql("half", "o_totalprice", "o")}),
        c AS (SELECT * FROM {_chi_sql("size", "rich", "o")} UNION ALL SELECT * FROM {_chi_sql("size", "half", "o")} UNION ALL SELECT * FROM {_chi_sql("rich", "half", "o")})
        SELECT col_a, col_b, 'categorical_to_numeric' AS type, round(eta_squared, 6) AS strength,
          CASE WHEN eta_squared >= 0.14 THEN 'very strong' WHEN eta_squared >= 0.06 THEN 'strong' ELSE 'moderate' END AS strength_label FROM k
        UNION ALL SELECT col_a, col_b, 'categorical_association', round({CORRECTED}, 6),
          CASE WHEN {CORRECTED} >= 0.4 THEN 'very strong' WHEN {CORRECTED} >= 0.25 THEN 'strong' ELSE 'moderate' END FROM c""",
)
def detect_relationships(spark, folder):
    orders = linked(spark, folder).drop("o_orderkey")
    found = stats.detect_relationships(orders)
    return rounded(found.select("col_a", "col_b", "type", "strength", "strength_label"), strength=6)


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


ACROSS = f"""WITH {LINKED}, k AS ({_union([_kruskal_sql(c, "o_totalprice", "o") for c in ("size", "rich", "half")])}),
  c AS ({_union([_chi_sql(a, b, "o") for a, b in (("size", "rich"), ("size", "half"), ("rich", "half"))])}),
  r AS (SELECT col_a, col_b, 'categorical_to_numeric' AS type, round(eta_squared, 6) AS strength, 'kruskal_wallis' AS method FROM k
        UNION ALL SELECT col_a, col_b, 'categorical_association', round({CORRECTED}, 6), 'chi_square' FROM c)"""


@REG.add(
    "detect_relationships_merged",
    ACROSS
    + """ SELECT 'prices' AS dataset, * FROM r WHERE col_a = 'size' AND col_b = 'o_totalprice'
          UNION ALL SELECT 'groups', * FROM r WHERE col_a = 'rich' AND col_b = 'half' UNION ALL SELECT 'merged', * FROM r""",
)
def detect_relationships_merged(spark, folder):
    orders = linked(spark, folder)
    a = orders.select("o_orderkey", "size", "o_totalprice")
    b = orders.select("o_orderkey", "rich", "half")
    found = stats.detect_across([("prices", a), ("groups", b), ("prices", a)])
    return rounded(found.select("dataset", "col_a", "col_b", "type", "strength", "method"), strength=6)


@REG.add(
    "relationship_sections",
    ACROSS + " SELECT type, count(*) AS relationships, max(strength) AS strongest FROM r GROUP BY 1",
)
def relationship_sections(spark, folder):
    found = stats.detect_relationships(linked(spark, folder).drop("o_orderkey"))
    return rounded(stats.relationship_sections(found), strongest=6)


@REG.add("pps_matrix")
def pps_matrix(spark, folder):
    return pps.pps_matrix(linked(spark, folder), ["o_totalprice", "size", "rich", "half", "o_orderpriority"])


@REG.add("pps_relationships")
def pps_relationships(spark, folder):
    scores = pps.pps_matrix(linked(spark, folder), ["o_totalprice", "size", "rich"])
    return pps.pps_relationships(scores)


@REG.add(
    "hierarchies",
    """WITH c AS (SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       p AS (SELECT 'c_mktsegment' AS a, 'n_name' AS b, c_mktsegment AS x, n_name AS y FROM c UNION ALL SELECT 'c_mktsegment', 'r_name', c_mktsegment, r_name FROM c
             UNION ALL SELECT 'n_name', 'r_name', n_name, r_name FROM c),
       g AS (SELECT a, b, x, count(DISTINCT y) AS d FROM p GROUP BY 1, 2, 3)
       SELECT a AS col_a, b AS col_b, a || ' fixes ' || b AS insight FROM g GROUP BY 1, 2 HAVING max(d) = 1 AND min(d) = 1 AND count(*) > 1""",
)
def hierarchies(spark, folder):
    customers = table(spark, folder, "customer")
    # Nations and regions are fixed small tables; their join side is broadcast by size.
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    found = relations.hierarchies(places.select("c_custkey", "c_mktsegment", "n_name", "r_name"))
    return found.select("col_a", "col_b", "insight")


def _sets(spark, folder):
    """Pearson pairs and mirrored, weaker copies of them under another method."""
    lines = table(spark, folder, "lineitem")
    pearson = stats.pearson_pairs(lines, ["l_quantity", "l_extendedprice", "l_discount"], least=0.0)
    other = pearson.filter("col_b <> 'l_discount'").select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.lit("predictive").alias("type"),
        F.round(F.col("strength") / 2, 4).alias("strength"), "direction", F.lit(None).cast("string").alias("method"), "insight",
    )
    return other, pearson


PAIRS = """p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, abs(corr(l_quantity, l_extendedprice)) AS s FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', abs(corr(l_quantity, l_discount)) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', abs(corr(l_extendedprice, l_discount)) FROM lineitem)"""


@REG.add(
    "merge_relationships",
    f"""WITH {PAIRS} SELECT CASE WHEN b = 'l_discount' THEN a ELSE b END AS col_a, CASE WHEN b = 'l_discount' THEN b ELSE a END AS col_b,
        CASE WHEN b = 'l_discount' THEN 'correlation' ELSE 'predictive' END AS type,
        CASE WHEN b = 'l_discount' THEN round(s, 3) ELSE round(round(s, 3) / 2, 4) END AS strength FROM p""",
)
def merge_relationships(spark, folder):
    return relations.merge_relationships(*_sets(spark, folder)).select("col_a", "col_b", "type", "strength")


@REG.add(
    "merge_relationships_later",
    f"WITH {PAIRS} SELECT a AS col_a, b AS col_b, 'correlation' AS type, round(s, 3) AS strength FROM p",
)
def merge_relationships_later(spark, folder):
    merged = relations.merge_relationships(*_sets(spark, folder), later_wins=True)
    return merged.select("col_a", "col_b", "type", "strength")


@REG.add(
    "normalize_method",
    f"""WITH {PAIRS} SELECT a AS col_a, b AS col_b, 'pearson' AS method FROM p
        UNION ALL SELECT b, a, 'custom_pps' FROM p WHERE b <> 'l_discount'""",
)
def normalize_method(spark, folder):
    other, pearson = _sets(spark, folder)
    return relations.with_method(other.unionByName(pearson)).select("col_a", "col_b", "method")


@REG.add("full_analyze")
def full_analyze(spark, folder):
    return analyze.analyze(linked(spark, folder), ["o_orderkey"]).relationships
