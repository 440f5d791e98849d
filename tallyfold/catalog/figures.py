"""Key figures, charts, typed questions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.base import Registry, damaged_orders, longs, rounded, table, DAMAGED_SQL
from tallyfold.operators import charts, facts, kpi, stats, tools
from tallyfold.operators.relations import strongest

REG = Registry()

JOINED = "SELECT l.*, o.o_orderpriority, o.o_orderstatus, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"


def order_lines(spark, folder):
    """Line items with the attributes of their order."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")


@REG.add(
    "kpi_scalars",
    """SELECT round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       count(l_extendedprice) AS count, round(stddev_samp(l_extendedprice), 4) AS std,
       round(var_samp(l_extendedprice), 2) AS var, count(DISTINCT l_extendedprice) AS nunique FROM lineitem""",
)
def kpi_scalars(spark, folder):
    out = kpi.scalar_kpis(table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(out, sum=2, mean=4, median=4, std=4, var=2)


@REG.add("kpi_rowcount", "SELECT count(*) AS row_count FROM lineitem")
def kpi_rowcount(spark, folder):
    return kpi.row_count_kpi(table(spark, folder, "lineitem"))


@REG.add(
    "kpi_mode",
    """SELECT props AS value, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1
       ORDER BY n DESC, value LIMIT 1""",
)
def kpi_mode(spark, folder):
    return kpi.mode_kpi(table(spark, folder, "events"), "props")


@REG.add(
    "kpi_group_argmax",
    """SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority IS NOT NULL
       GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 1""",
)
def kpi_group_argmax(spark, folder):
    return rounded(kpi.group_argmax(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice"), value=2)


@REG.add(
    "kpi_group_median",
    """SELECT event_type, user_id, round(quantile_cont(value, 0.5), 4) AS value FROM events GROUP BY 1, 2""",
)
def kpi_group_median(spark, folder):
    return rounded(kpi.group_values(table(spark, folder, "events"), ["event_type", "user_id"], "value", "median"), value=4)


@REG.add(
    "chart_groupby",
    """SELECT l_returnflag AS x, round(coalesce(sum(l_quantity), 0), 2) AS y FROM lineitem
       WHERE l_returnflag IS NOT NULL GROUP BY 1""",
)
def chart_groupby(spark, folder):
    return rounded(charts.group_chart(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", "sum"), y=2)


CROSS = """WITH p AS (SELECT l_returnflag AS r, l_shipdate AS d, l_linestatus AS c FROM lineitem),
 rows_ AS (SELECT DISTINCT r FROM p), cols_ AS (SELECT DISTINCT c FROM p),
 n AS (SELECT r, c, count(*) AS n FROM p GROUP BY 1, 2),
 full_ AS (SELECT rows_.r, cols_.c, coalesce(n.n, 0) AS n FROM rows_ CROSS JOIN cols_
           LEFT JOIN n ON n.r = rows_.r AND n.c = cols_.c)"""


@REG.add("chart_crosstab", CROSS + " SELECT r AS row, c AS \"column\", n AS value FROM full_")
def chart_crosstab(spark, folder):
    return charts.crosstab(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


@REG.add(
    "chart_crosstab_norm",
    CROSS + " SELECT r AS row, c AS \"column\", round(n / sum(n) OVER (PARTITION BY r), 6) AS value FROM full_",
)
def chart_crosstab_norm(spark, folder):
    return rounded(charts.crosstab(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", True), value=6)


@REG.add(
    "chart_value_counts",
    "SELECT l_suppkey AS x, count(*) AS y FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY y DESC, x LIMIT 20",
)
def chart_value_counts(spark, folder):
    return charts.value_counts_chart(table(spark, folder, "lineitem"), "l_suppkey")


@REG.add("chart_scatter", f"WITH t AS ({DAMAGED_SQL}) SELECT CAST(customer AS DOUBLE) AS x, amount AS y FROM t WHERE amount IS NOT NULL")
def chart_scatter(spark, folder):
    return charts.scatter(damaged_orders(spark, folder), "customer", "amount")


@REG.add(
    "chart_metric_summary",
    """SELECT 'l_quantity' AS x, round(sum(l_quantity), 2) AS y FROM lineitem
       UNION ALL SELECT 'l_extendedprice', round(sum(l_extendedprice), 2) FROM lineitem
       UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem""",
)
def chart_metric_summary(spark, folder):
    out = charts.metric_summary(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(out, y=2)


BATCH = [
    kpi.Kpi("revenue", "sum", "l_extendedprice"),
    kpi.Kpi("mean quantity", "mean", "l_quantity"),
    kpi.Kpi("median price", "median", "l_extendedprice"),
    kpi.Kpi("lines", "row_count"),
    kpi.Kpi("common flag", "mode", "l_returnflag"),
    kpi.Kpi("best flag", "sum", "l_extendedprice", "l_returnflag"),
    kpi.Kpi("broken", "sum", "no_such_column"),
]


@REG.add(
    "kpi_batch",
    """SELECT 'revenue' AS kpi_name, round(sum(l_extendedprice), 2) AS value, CAST(NULL AS VARCHAR) AS label FROM lineitem
       UNION ALL SELECT 'mean quantity', round(avg(l_quantity), 2), NULL FROM lineitem
       UNION ALL SELECT 'median price', round(quantile_cont(l_extendedprice, 0.5), 2), NULL FROM lineitem
       UNION ALL SELECT 'lines', CAST(count(*) AS DOUBLE), NULL FROM lineitem
       UNION ALL (SELECT 'common flag', CAST(count(*) AS DOUBLE), l_returnflag FROM lineitem GROUP BY l_returnflag
                  ORDER BY count(*) DESC, l_returnflag LIMIT 1)
       UNION ALL (SELECT 'best flag', round(sum(l_extendedprice), 2), l_returnflag FROM lineitem GROUP BY l_returnflag
                  ORDER BY sum(l_extendedprice) DESC, l_returnflag LIMIT 1)""",
)
def kpi_batch(spark, folder):
    return rounded(kpi.run_kpis(table(spark, folder, "lineitem"), BATCH)[0], value=2)


@REG.add(
    "chart_batch",
    """SELECT 'by flag' AS title, l_returnflag AS x, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 2
       UNION ALL SELECT 'by mode', CAST(l_linenumber AS VARCHAR), CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 2
       UNION ALL SELECT 'totals', 'l_tax', round(sum(l_tax), 2) FROM lineitem""",
)
def chart_batch(spark, folder):
    made, _ = charts.run_charts(
        table(spark, folder, "lineitem"),
        [
            {"title": "by flag", "chart": "group", "x": "l_returnflag", "y": "l_quantity"},
            {"title": "by mode", "chart": "value_counts", "column": "l_linenumber"},
            {"title": "totals", "chart": "summary", "metrics": ["l_tax"]},
            {"title": "broken", "chart": "group", "x": "nothing", "y": "l_tax"},
        ],
    )
    return rounded(charts.union_charts(made), y=2)


@REG.add(
    "format_kpi",
    """WITH g AS (SELECT user_id, round(sum(value), 2) AS value FROM events GROUP BY 1)
       SELECT user_id, value, CASE WHEN value IS NULL THEN 'N/A'
         WHEN abs(value) >= 1000000 THEN printf('%.2fM', value / 1000000.0)
         WHEN abs(value) >= 1000 THEN printf('%.2fK', value / 1000.0) ELSE printf('%.2f', value) END AS formatted FROM g""",
)
def format_kpi(spark, folder):
    sums = kpi.group_values(table(spark, folder, "events"), ["user_id"], "value", "sum")
    return kpi.formatted(rounded(sums, value=2))


@REG.add(
    "kpi_block",
    """SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average, count(*) AS row_count
       FROM orders""",
)
def kpi_block(spark, folder):
    return rounded(kpi.kpi_block(table(spark, folder, "orders"), "o_totalprice"), total=2, average=4)


@REG.add(
    "kpi_monthly_trend",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1""",
)
def kpi_monthly_trend(spark, folder):
    return rounded(kpi.monthly_trend(table(spark, folder, "orders"), "o_totalprice", ["o_orderdate"]), value=2)


@REG.add(
    "kpi_top_dimension",
    f"""WITH t AS ({JOINED}) SELECT concat(l_returnflag, '/', o_orderpriority) AS key,
        round(sum(l_extendedprice), 2) AS value FROM t GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 10""",
)
def kpi_top_dimension(spark, folder):
    lines = order_lines(spark, folder).withColumn("label", F.concat_ws("/", "l_returnflag", "o_orderpriority"))
    return rounded(kpi.top_by_dimension(lines, "l_extendedprice", "label"), value=2)


FIRST = "concat('ts=', strftime(ts, '%Y-%m-%d %H:%M:%S'))"


@REG.add(
    "metric_facts",
    """WITH e AS (SELECT *, concat('event_type=', event_type) AS w FROM events)
       SELECT CAST(1 AS BIGINT) AS position, 'value' AS metric, round(sum(value), 4) AS total, round(avg(value), 4) AS average,
         round(min(value), 4) AS min_value, (SELECT w FROM e ORDER BY value, event_id LIMIT 1) AS min_where,
         round(max(value), 4) AS max_value, (SELECT w FROM e ORDER BY value DESC, event_id LIMIT 1) AS max_where,
         count(value) AS non_null_rows FROM e
       UNION ALL
       SELECT 2, 'user_id', round(CAST(sum(user_id) AS DOUBLE), 4), round(avg(user_id), 4),
         CAST(min(user_id) AS DOUBLE), (SELECT w FROM e ORDER BY user_id, event_id LIMIT 1),
         CAST(max(user_id) AS DOUBLE), (SELECT w FROM e ORDER BY user_id DESC, event_id LIMIT 1), count(user_id) FROM e""",
)
def metric_facts(spark, folder):
    out = facts.metric_facts(
        table(spark, folder, "events"), ["user_id", "value"], "value", None, ["event_type"], ["event_id"]
    )
    return rounded(longs(out, "position"), total=4, average=4)


@REG.add(
    "trend_fact",
    """WITH t AS (SELECT CAST(o_orderdate AS VARCHAR) AS label, o_orderdate AS t, o_orderkey AS k, o_totalprice AS v FROM orders),
       f AS (SELECT * FROM t ORDER BY t, k LIMIT 1), l AS (SELECT * FROM t ORDER BY t DESC, k DESC LIMIT 1),
       p AS (SELECT * FROM t ORDER BY v DESC, t, k LIMIT 1), w AS (SELECT * FROM t ORDER BY v, t, k LIMIT 1)
       SELECT 'o_orderdate' AS time_column, 'o_totalprice' AS metric, f.label AS first_period, f.v AS first_value,
         l.label AS last_period, l.v AS last_value, round(l.v - f.v, 4) AS absolute_change,
         round((l.v - f.v) / f.v * 100, 4) AS percent_change, p.label AS peak_period, p.v AS peak_value,
         w.label AS low_period, w.v AS low_value FROM f, l, p, w""",
)
def trend_fact(spark, folder):
    return facts.trend_fact(table(spark, folder, "orders"), "o_totalprice", "o_orderdate", ["o_orderkey"])


@REG.add(
    "temporal_pick",
    """SELECT 'l_shipdate' AS "column", 0.0::DOUBLE AS number_rate, 0.0::DOUBLE AS year_rate,
         avg(CASE WHEN l_shipdate IS NULL THEN 0.0 ELSE 1.0 END) AS date_rate FROM lineitem
       UNION ALL SELECT 'l_orderkey', avg(CASE WHEN l_orderkey IS NULL THEN 0.0 ELSE 1.0 END),
         round(avg(CASE WHEN l_orderkey BETWEEN 1000 AND 3000 THEN 1.0 ELSE 0.0 END), 6),
         avg(CASE WHEN l_orderkey IS NULL THEN 0.0 ELSE 1.0 END) FROM lineitem""",
)
def temporal_pick(spark, folder):
    lines = table(spark, folder, "lineitem")
    picked = facts.pick_temporal(lines)
    return rounded(facts.temporal_rates(lines, [picked, "l_orderkey"]), year_rate=6)


@REG.add(
    "dimension_facts",
    """WITH u AS (SELECT 'event_type' AS dimension, event_type AS v, value FROM events
                  UNION ALL SELECT 'props', props, value FROM events),
       g AS (SELECT dimension, v, count(*) AS n, sum(value) AS s FROM u WHERE v IS NOT NULL GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, v) AS a,
                    row_number() OVER (PARTITION BY dimension ORDER BY s DESC, v) AS b FROM g)
       SELECT dimension, 'count' AS ranked_by, a AS position, v AS value, CAST(n AS DOUBLE) AS measure FROM r WHERE a <= 5
       UNION ALL SELECT dimension, 'metric_total', b, v, round(s, 4) FROM r WHERE b <= 5""",
)
def dimension_facts(spark, folder):
    out = facts.dimension_facts(table(spark, folder, "events"), ["event_type", "props"], "value")
    return rounded(longs(out, "position"), measure=4)


@REG.add(
    "quality_facts",
    f"""WITH t AS (SELECT customer, status, amount, priority, placed FROM ({DAMAGED_SQL})),
        m AS (SELECT count(*) AS n, count(*) - count(status) AS s, count(*) - count(amount) AS a,
              count(*) - count(priority) AS p FROM t),
        d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY customer, status, amount, priority, placed)),
        w AS (SELECT string_agg(c || ':' || k, ', ' ORDER BY k DESC, i) AS text FROM
              (SELECT 'status' AS c, s AS k, 1 AS i FROM m UNION ALL SELECT 'amount', a, 2 FROM m UNION ALL SELECT 'priority', p, 3 FROM m))
        SELECT m.n AS row_count, CAST(5 AS BIGINT) AS column_count, CAST(d.dup AS BIGINT) AS duplicate_rows,
          m.s + m.a + m.p AS missing_cells, w.text AS top_missing_columns FROM m, d, w""",
)
def quality_facts(spark, folder):
    return longs(facts.quality_facts(damaged_orders(spark, folder).drop("row_id")), "column_count", "missing_cells")


@REG.add(
    "relationship_facts",
    """WITH p AS (SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
        UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
        UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem
        UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem)
       SELECT col_a, col_b, round(abs(r), 3) AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
       FROM p WHERE abs(r) > 0 ORDER BY 3 DESC, 1, 2 LIMIT 3""",
)
def relationship_facts(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = stats.pearson_pairs(table(spark, folder, "lineitem"), columns, least=0.0)
    return strongest(found, 3).select("col_a", "col_b", "strength", "direction")


def _number(e: str) -> str:
    """Fact number text in SQL."""
    v = f"round({e}, 4)"
    return (
        f"CASE WHEN {e} IS NULL THEN 'n/a' WHEN abs({v}) >= 1000 AND {v} = floor({v}) THEN format('{{:,.0f}}', {v}) "
        f"WHEN abs({v}) >= 1000 THEN format('{{:,.2f}}', {v}) "
        f"ELSE regexp_replace(regexp_replace(printf('%.2f', {v}), '0+$', ''), '\\.$', '') END"
    )


@REG.add(
    "fact_lines",
    f"""WITH d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) g),
        q AS (SELECT count(*) AS n FROM orders),
        m AS (SELECT sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
        lo AS (SELECT o_orderstatus AS w FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1),
        hi AS (SELECT o_orderstatus AS w FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),
        g AS (SELECT o_orderstatus AS v, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
        gc AS (SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) AS t FROM (SELECT * FROM g ORDER BY n DESC, v LIMIT 3)),
        gs AS (SELECT string_agg(v || ' (' || {_number("s")} || ')', ', ' ORDER BY s DESC, v) AS t FROM (SELECT * FROM g ORDER BY s DESC, v LIMIT 3)),
        t AS (SELECT CAST(o_orderdate AS VARCHAR) AS label, o_orderdate AS t, o_orderkey AS k, o_totalprice AS v FROM orders),
        tf AS (SELECT * FROM t ORDER BY t, k LIMIT 1), tl AS (SELECT * FROM t ORDER BY t DESC, k DESC LIMIT 1),
        tp AS (SELECT * FROM t ORDER BY v DESC, t, k LIMIT 1), tw AS (SELECT * FROM t ORDER BY v, t, k LIMIT 1)
        SELECT CAST(1 AS BIGINT) AS section, CAST(1 AS BIGINT) AS position, 'table orders: rows=' || n || ', columns=6, primary=o_totalprice' AS line FROM q
        UNION ALL SELECT 1, 2, 'quality: duplicates=' || dup || ', missing=0' FROM d
        UNION ALL SELECT 2, 1, 'o_totalprice: sum=' || {_number("m.s")} || ' mean=' || {_number("m.a")} || ' least=' || {_number("m.lo")}
          || ' [o_orderstatus=' || lo.w || '] greatest=' || {_number("m.hi")} || ' [o_orderstatus=' || hi.w || ']' FROM m, lo, hi
        UNION ALL SELECT 3, 1, 'o_totalprice over o_orderdate: ' || tf.label || '=' || {_number("tf.v")} || ' -> ' || tl.label || '=' || {_number("tl.v")}
          || ', moved ' || {_number("(tl.v - tf.v)")} || ' (' || {_number("((tl.v - tf.v) / tf.v * 100)")} || '%), high ' || tp.label || '=' || {_number("tp.v")}
          || ', low ' || tw.label || '=' || {_number("tw.v")} FROM tf, tl, tp, tw
        UNION ALL SELECT 4, 1, 'o_orderstatus by count: ' || t FROM gc
        UNION ALL SELECT 4, 2, 'o_orderstatus by total: ' || t FROM gs""",
)
def fact_lines(spark, folder):
    orders = table(spark, folder, "orders")
    out = facts.fact_lines(
        "orders",
        "o_totalprice",
        facts.quality_facts(orders),
        facts.metric_facts(orders, ["o_totalprice"], None, None, ["o_orderstatus"], ["o_orderkey"]),
        facts.trend_fact(orders, "o_totalprice", "o_orderdate", ["o_orderkey"]),
        facts.dimension_facts(orders, ["o_orderstatus"], "o_totalprice"),
    )
    return longs(out, "section", "position")


@REG.add(
    "kpi_hints",
    """WITH tr AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1),
       g AS (SELECT o_orderpriority AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3)
       SELECT CAST(1 AS BIGINT) AS position, 'o_totalprice: sum ' || printf('%.2f', round(sum(o_totalprice), 2)) AS line FROM orders
       UNION ALL SELECT 2, 'months ' || (SELECT count(*) FROM tr) || ', latest ' || p || ' ' || printf('%.2f', v) FROM (SELECT * FROM tr ORDER BY p DESC LIMIT 1)
       UNION ALL SELECT 3, 'largest o_orderpriority: ' || string_agg(k || ' ' || printf('%.2f', v), ', ' ORDER BY v DESC, k) FROM g
       UNION ALL SELECT 4, 'rows ' || count(*) FROM orders""",
)
def kpi_hints(spark, folder):
    orders = table(spark, folder, "orders")
    out = facts.kpi_hints(
        "o_totalprice",
        rounded(kpi.kpi_block(orders, "o_totalprice"), total=2),
        rounded(kpi.monthly_trend(orders, "o_totalprice", ["o_orderdate"]), value=2),
        rounded(kpi.top_by_dimension(orders, "o_totalprice", "o_orderpriority"), value=2),
        "o_orderpriority",
    )
    return longs(out, "position")


@REG.add(
    "tool_filter_agg",
    """SELECT l_linestatus, round(avg(l_extendedprice), 4) AS value FROM lineitem
       WHERE l_shipdate >= DATE '1997-01-01' AND l_quantity > 10 GROUP BY 1""",
)
def tool_filter_agg(spark, folder):
    where = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 10)
    out = tools.filter_aggregate(table(spark, folder, "lineitem"), where, "l_extendedprice", "mean", ["l_linestatus"])
    return rounded(out, value=4)


def _describe_sql(column: str, source: str) -> str:
    c = column
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
      round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
      round(quantile_cont({c}, 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {source}"""


DESCRIBE_DIGITS = {"mean": 4, "std": 4, "min": 4, "q25": 4, "q50": 4, "q75": 4, "max": 4}


@REG.add("tool_describe", _describe_sql("value", "events"))
def tool_describe(spark, folder):
    return rounded(tools.describe_columns(table(spark, folder, "events"), ["value"]), **DESCRIBE_DIGITS)


@REG.add(
    "tool_correlation",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem)
       SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(a, 6) AS r FROM r UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(a, 6) FROM r
       UNION ALL SELECT 'l_quantity', 'l_tax', round(b, 6) FROM r UNION ALL SELECT 'l_tax', 'l_quantity', round(b, 6) FROM r
       UNION ALL SELECT 'l_extendedprice', 'l_tax', round(c, 6) FROM r UNION ALL SELECT 'l_tax', 'l_extendedprice', round(c, 6) FROM r
       UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 FROM r UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0 FROM r
       UNION ALL SELECT 'l_tax', 'l_tax', 1.0 FROM r""",
)
def tool_correlation(spark, folder):
    out = tools.correlations(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(out, r=6)


@REG.add(
    "tool_bounded",
    "SELECT doc_id, left(text, 500) AS text, lang FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20",
)
def tool_bounded(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return tools.bounded(documents, [F.desc(F.length("text")), "doc_id"])


@REG.add(
    "tool_expr",
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       max(CAST(year(l_shipdate) AS BIGINT)) AS last_year FROM lineitem GROUP BY 1""",
)
def tool_expr(spark, folder):
    return tools.evaluate_aggregates(
        table(spark, folder, "lineitem"),
        {
            "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)",
            "last_year": "max(CAST(year(l_shipdate) AS BIGINT))",
        },
        ["l_returnflag"],
    )


SERIES = "SELECT event_type AS x, round(sum(value), 2) AS total, round(avg(CASE WHEN value > 900 THEN value END), 4) AS high FROM events GROUP BY 1"


@REG.add(
    "chart_multi_series",
    f"""WITH g AS ({SERIES}) SELECT x, 'total' AS series, coalesce(total, 0.0) AS value FROM g
        UNION ALL SELECT x, 'high', coalesce(high, 0.0) FROM g""",
)
def chart_multi_series(spark, folder):
    grouped = table(spark, folder, "events").groupBy(F.col("event_type").alias("x")).agg(
        F.round(F.sum("value"), 2).alias("total"),
        F.round(F.avg(F.when(F.col("value") > 900, F.col("value"))), 4).alias("high"),
    )
    return charts.multi_series(grouped, "x", ["total", "high"])


@REG.add(
    "chart_top_points",
    """SELECT user_id AS label, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def chart_top_points(spark, folder):
    return charts.top_points(table(spark, folder, "events"), "user_id", "value")


@REG.add(
    "kpi_count_gaps",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS value FROM orders GROUP BY 1""",
)
def kpi_count_gaps(spark, folder):
    gaps = table(spark, folder, "orders").selectExpr(
        "o_orderstatus", "CASE WHEN o_orderkey % 3 = 0 THEN double('NaN') ELSE o_totalprice END AS price"
    )
    return kpi.group_values(gaps, ["o_orderstatus"], "price", "count")
