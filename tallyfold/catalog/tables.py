"""Joins, metadata tables, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.base import Registry, longs, rounded, table
from tallyfold.functions import dates, numbers, text
from tallyfold.operators import merge, tables

REG = Registry()


def _halves(spark, folder):
    """All customers twice, in part under other keys so that each side has keys of its own, with null keys on both sides."""
    customers = table(spark, folder, "customer")
    left = customers.selectExpr(
        "CASE WHEN c_custkey % 200 = 1 THEN NULL ELSE c_custkey END AS c_custkey", "c_name", "c_acctbal"
    )
    right = customers.selectExpr(
        "CASE WHEN c_custkey % 200 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN -c_custkey ELSE c_custkey END AS c_custkey",
        "c_mktsegment",
        "c_nationkey",
    )
    return left, right


HALVES = """l AS (SELECT CASE WHEN c_custkey % 200 = 1 THEN NULL ELSE c_custkey END AS k, c_name, c_acctbal FROM customer),
  r AS (SELECT CASE WHEN c_custkey % 200 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN -c_custkey ELSE c_custkey END AS k, c_mktsegment, c_nationkey FROM customer),
  m AS (SELECT coalesce(l.k, r.k) AS c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k)"""


@REG.add("merge_full_outer", f"WITH {HALVES} SELECT * FROM m")
def merge_full_outer(spark, folder):
    return merge.outer_merge(*_halves(spark, folder))


@REG.add(
    "merge_chain",
    f"""WITH {HALVES}, n AS (SELECT n_nationkey AS c_nationkey, n_name FROM nation),
        c AS (SELECT coalesce(m.c_nationkey, n.c_nationkey) AS c_nationkey, c_custkey, c_name, c_acctbal, c_mktsegment, n_name
              FROM m FULL JOIN n ON m.c_nationkey IS NOT DISTINCT FROM n.c_nationkey) SELECT * FROM c""",
)
def merge_chain(spark, folder):
    left, right = _halves(spark, folder)
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    steps = [("left", left), ("right", right), ("part", table(spark, folder, "part")), ("nation", nations)]
    return merge.merge_all(steps, count_rows=False)[0]


@REG.add(
    "merge_log",
    f"""WITH {HALVES}, a AS (SELECT (SELECT count(*) FROM l) AS b, (SELECT count(*) FROM m) AS e)
        SELECT CAST(1 AS BIGINT) AS step, 'left' AS "left", 'right' AS "right", 'c_custkey' AS join_columns, b AS rows_before, 'merged' AS status, e AS rows_after FROM a
        UNION ALL SELECT 2, 'left+right', 'part', '', e, 'skipped: no common columns', e FROM a""",
)
def merge_log(spark, folder):
    left, right = _halves(spark, folder)
    result, log = merge.merge_all([("left", left), ("right", right), ("part", table(spark, folder, "part"))])
    out = merge.merge_log_table(result, log).select(
        "step", "left", "right", F.array_join("join_columns", ",").alias("join_columns"), "rows_before", "status", "rows_after"
    )
    return longs(out, "step")


@REG.add(
    "owner_counts",
    """WITH d AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 1 END) AS k FROM lineitem GROUP BY 1)
       SELECT o_custkey, count(*) AS datasets, CAST(coalesce(sum(n), 0) AS BIGINT) AS dashboards, CAST(coalesce(sum(k), 0) AS BIGINT) AS kpis
       FROM orders LEFT JOIN d ON o_orderkey = l_orderkey GROUP BY 1""",
)
def owner_counts(spark, folder):
    """Customers own orders, orders carry lines, lines hold a JSON list of figures."""
    datasets = table(spark, folder, "orders").select(F.col("o_orderkey").alias("dataset"), "o_custkey")
    dashboards = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("dataset"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit('["a","b","c"]')).otherwise(F.lit('["a"]')).alias("kpis"),
    )
    return tables.owner_counts(datasets, dashboards, "dataset", "o_custkey", "kpis")


@REG.add(
    "purge_owner",
    """WITH own AS (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)
       SELECT 'orders' AS table_name, count(*) AS rows FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM own)
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM own)""",
)
def purge_owner(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    owned = orders.filter("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("id"))
    kept = merge.purge({"orders": (orders, "o_orderkey"), "lineitem": (lines, "l_orderkey")}, owned)
    count = lambda name: kept[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
    return count("orders").unionByName(count("lineitem"))


@REG.add(
    "semi_join_ids",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def semi_join_ids(spark, folder):
    ids = table(spark, folder, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.keep_rows_of(table(spark, folder, "customer"), ids, "c_custkey").select("c_custkey", "c_mktsegment")


@REG.add("page_orders", "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def page_orders(spark, folder):
    page = tables.page(table(spark, folder, "orders"), "o_orderdate", "o_orderkey", 200, 100)
    return page.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@REG.add("owner_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def owner_page(spark, folder):
    orders = table(spark, folder, "orders")
    return tables.owner_page(orders, F.col("o_custkey") == 7, "o_orderdate", "o_orderkey", 0, 5).select("o_orderkey", "o_totalprice")


@REG.add(
    "latest_order_per_customer",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
       SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1""",
)
def latest_order_per_customer(spark, folder):
    latest = tables.latest_per_key(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice")


@REG.add(
    "latest_log_with_metadata",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'O')
       SELECT o_custkey, o_orderkey, o_orderstatus AS metadata FROM k WHERE rn = 1""",
)
def latest_log_with_metadata(spark, folder):
    logs = table(spark, folder, "orders").selectExpr(
        "o_custkey", "o_orderkey", "CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS metadata"
    )
    return tables.latest_with_metadata(logs, "o_custkey", "o_orderkey", "metadata")


@REG.add(
    "set_ops_columns",
    """SELECT 'both' AS side, count(*) AS keys FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
       UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
       UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""",
)
def set_ops_columns(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    orders = table(spark, folder, "orders")
    rich = orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key"))
    sides = {
        "both": customers.intersect(rich),
        "only_customer": customers.subtract(rich),
        "either": customers.union(orders.select("o_custkey")).distinct(),
    }
    parts = [d.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(s).alias("side"), "keys") for s, d in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@REG.add(
    "scalar_text",
    """SELECT p_partkey, trim(lower(concat('  ', p_name, ' '))) AS tidy, upper(p_brand) AS upper, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits,
       regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_matches(p_name, 'ring|bolt') AS has_part, p_type IN ('ECONOMY', 'SMALL') AS listed,
       left(sha1(concat(CAST(p_partkey AS VARCHAR), ':', p_type)), 12) AS version, left(p_name, 4) AS head,
       CAST(len(list_distinct(regexp_extract_all(lower(p_name), '([a-z0-9_]+)', 1))) AS BIGINT) AS words FROM part""",
)
def scalar_text(spark, folder):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, folder, "part").select(
        "p_partkey",
        text.tidy(F.concat(F.lit("  "), name, F.lit(" ")), standardize=True).alias("tidy"),
        F.upper(brand).alias("upper"),
        F.regexp_replace(brand, "[^0-9]", "").alias("digits"),
        F.regexp_extract(brand, "#([0-9]+)", 1).alias("number"),
        name.rlike("ring|bolt").alias("has_part"),
        F.col("p_type").isin("ECONOMY", "SMALL").alias("listed"),
        text.source_version(F.col("p_partkey").cast("string"), F.col("p_type")).alias("version"),
        F.left(name, F.lit(4)).alias("head"),
        F.size(text.tokens(name)).cast("long").alias("words"),
    )


@REG.add(
    "scalar_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
       strftime(o_orderdate, '%d/%m/%Y') AS european, CAST(year(o_orderdate) AS BIGINT) AS year, true AS parses FROM orders""",
)
def scalar_dates(spark, folder):
    day = F.col("o_orderdate")
    european = F.date_format(day, dates.java_pattern("%d/%m/%Y"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        dates.month_text(day).alias("month"),
        F.date_format(F.date_trunc("month", day), "yyyy-MM-dd").alias("month_start"),
        european.alias("european"),
        F.year(day).cast("long").alias("year"),
        (dates.parse_date(european, day_first=True) == day.cast("timestamp")).alias("parses"),
    )


@REG.add(
    "scalar_math",
    """SELECT event_id, round(ln(1 + value), 6) AS log, round(exp(ln(1 + value)) - 1, 4) AS back, round(abs(value - 50), 4) AS gap,
       value BETWEEN 10 AND 100 AS inside, round(greatest(least(value, 100), 10), 4) AS clipped, abs(value - round(value)) <= 1e-8 + 1e-5 * abs(round(value)) AS whole FROM events""",
)
def scalar_math(spark, folder):
    value = F.col("value")
    out = table(spark, folder, "events").select(
        "event_id",
        F.log1p(value).alias("log"),
        F.expm1(F.log1p(value)).alias("back"),
        F.abs(value - 50).alias("gap"),
        value.between(10, 100).alias("inside"),
        F.greatest(F.least(value, F.lit(100.0)), F.lit(10.0)).alias("clipped"),
        numbers.is_whole(value).alias("whole"),
    )
    return rounded(out, log=6, back=4, gap=4, clipped=4)


@REG.add(
    "scalar_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS fields FROM events""",
)
def scalar_json(spark, folder):
    parsed = F.from_json("props", "map<string,bigint>")
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(parsed).cast("long").alias("fields")
    )
