"""Sources, profiles, roles and categories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyfold.catalog.base import DAMAGED_SQL, Registry, damaged_orders, longs, rounded, table
from tallyfold.catalog.figures import DESCRIBE_DIGITS, _describe_sql
from tallyfold.operators import profile, relations, roles, stats
from tallyfold.operators.outliers import fit, outlier_counts
from tallyfold.operators.merge import replace_by_key
from tallyfold.operators.tables import preview
from tallyfold.plans.freq import side_by_side
from tallyfold.session import shared_folder
from tallyfold.sources.readers import read_csv, read_table
from tallyfold.sources.sinks import save_new
from tallyfold.streaming.ingest import ingest_folder, manifest, read_stage, run_stages

REG = Registry()


@REG.add(
    "scan_lineitem",
    """SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' AND l_returnflag = 'R'""",
)
def scan_lineitem(spark, folder):
    lines = read_table(spark, f"{folder}/lineitem.parquet")
    late = F.col("l_shipdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return lines.filter(late & (F.col("l_returnflag") == "R")).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"
    )


@REG.add("csv_round_trip", "SELECT doc_id, md5(text) AS text_md5, source, n_chars FROM documents WHERE text <> ''")
def csv_round_trip(spark, folder):
    """Whole texts with their quotes and line breaks, written as CSV and read back."""
    path = save_new(
        table(spark, folder, "documents").select("doc_id", "text", "source", "n_chars").filter("text <> ''"),
        f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}.csv",
        "csv",
    )
    back = read_csv(spark, path, ",", "doc_id long, text string, source string, n_chars long")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source", "n_chars")


@REG.add(
    "stream_orders",
    """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""",
)
def stream_orders(spark, folder):
    """The orders as a stream of files, the stream started twice and its first batch run again: each order counts once."""
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source, target = f"{root}/arriving", f"{root}/stored"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.repartition(4, "o_orderkey").write.parquet(source)
    schema = orders.schema
    stages = {"rows": lambda df: df, "profile": lambda df: profile.missing_by_column(df, keep_complete=True)}
    for _ in range(2):
        ingest_folder(spark, source, schema, target, "o_orderkey", max_files=2, stages=stages).awaitTermination()
    first = manifest(spark, target).filter("stage = 'rows'").orderBy("batch").first()
    run_stages(spark.read.schema(schema).parquet(first["path"]), first["batch"], target, stages)
    return read_stage(spark, target, "rows", schema).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REG.add("preview_orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50")
def preview_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return preview(orders, ["o_orderkey"])


@REG.add(
    "upsert_latest",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0
       UNION ALL SELECT o_orderkey, 'X', round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 7 = 0""",
)
def upsert_latest(spark, folder):
    old = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 7 = 0").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice")
    )
    return replace_by_key(old, new, ["o_orderkey"])


@REG.add("table_shape", "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem")
def table_shape(spark, folder):
    return longs(profile.table_shape(table(spark, folder, "lineitem")), "column_count")


DESCRIBED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@REG.add("describe_lineitem", " UNION ALL ".join(_describe_sql(c, "lineitem") for c in DESCRIBED))
def describe_lineitem(spark, folder):
    return rounded(profile.describe(table(spark, folder, "lineitem"), DESCRIBED), **DESCRIBE_DIGITS)


@REG.add(
    "structural_categories",
    """WITH n AS (SELECT count(*) AS n, count(DISTINCT text) AS t, count(DISTINCT lang) AS l, count(DISTINCT source) AS s FROM documents)
       SELECT 'doc_id' AS "column", 'numeric' AS category UNION ALL SELECT 'n_chars', 'numeric'
       UNION ALL SELECT 'text', CASE WHEN t < 0.5 * n THEN 'categorical' ELSE 'text' END FROM n
       UNION ALL SELECT 'lang', CASE WHEN l < 0.5 * n THEN 'categorical' ELSE 'text' END FROM n
       UNION ALL SELECT 'source', CASE WHEN s < 0.5 * n THEN 'categorical' ELSE 'text' END FROM n""",
)
def structural_categories(spark, folder):
    return profile.structural_categories(table(spark, folder, "documents"))


@REG.add(
    "missing_by_column",
    f"""WITH t AS ({DAMAGED_SQL}) SELECT 'status' AS "column", count(*) - count(status) AS missing FROM t
        UNION ALL SELECT 'amount', count(*) - count(amount) FROM t UNION ALL SELECT 'priority', count(*) - count(priority) FROM t""",
)
def missing_by_column(spark, folder):
    return profile.missing_by_column(damaged_orders(spark, folder))


REPORT = f"""t AS (SELECT customer, status, amount, priority, placed FROM ({DAMAGED_SQL})),
  m AS (SELECT count(*) AS n, 3 * count(*) - count(status) - count(amount) - count(priority) AS missing FROM t),
  d AS (SELECT CAST(sum(n - 1) AS BIGINT) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY customer, status, amount, priority, placed)),
  r AS (SELECT n AS row_count, CAST(5 AS BIGINT) AS column_count, missing AS missing_cells,
        round(missing / (n * 5) * 100, 2) AS missing_pct, dup AS duplicate_rows, round(dup / n * 100, 2) AS duplicate_pct FROM m, d)"""


@REG.add("quality_report_orders", f"WITH {REPORT} SELECT * FROM r")
def quality_report_orders(spark, folder):
    return longs(profile.quality_report(damaged_orders(spark, folder).drop("row_id")), "column_count")


@REG.add(
    "quality_score",
    f"""WITH {REPORT}, x AS (SELECT amount FROM t WHERE amount IS NOT NULL),
        neg AS (SELECT count(*) AS outliers FROM x WHERE amount < 0)
        SELECT r.*, round(greatest(0, 100 - 0.4 * least(missing_pct, 100) - 0.2 * least(duplicate_pct, 100)
          - 0.2 * least(outliers / row_count * 100, 100) - 2.0), 2) AS quality_score FROM r, neg""",
)
def quality_score(spark, folder):
    """Score of the damaged orders; the amounts that break their role's domain count as outliers."""
    orders = damaged_orders(spark, folder).drop("row_id")
    report = profile.quality_report(orders)
    found = outlier_counts(orders, fit(orders, "auto", 1.5, ["amount"]))
    share = found.agg(F.coalesce(F.sum("critical"), F.lit(0)).alias("_outliers"))
    scored = profile.quality_score(
        side_by_side(report, share), F.col("_outliers") / F.col("row_count") * 100, F.lit(True), F.lit(1.0)
    )
    return longs(scored.drop("_outliers"), "column_count")


@REG.add(
    "numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
        round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
        count(*) - count({c}) AS missing FROM ({DAMAGED_SQL})"""
        for c in ("row_id", "customer", "amount")
    ),
)
def numeric_summary(spark, folder):
    out = profile.numeric_summary(damaged_orders(spark, folder))
    return rounded(out, mean=4, median=4, std=4, min=4, max=4)


@REG.add(
    "categorical_summary",
    "WITH t AS ("
    + DAMAGED_SQL
    + """), f AS (SELECT 'status' AS c, status AS v, count(*) AS n FROM t WHERE status IS NOT NULL GROUP BY 2
           UNION ALL SELECT 'priority', priority, count(*) FROM t WHERE priority IS NOT NULL GROUP BY 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY c) AS u FROM f)
         SELECT c AS "column", CASE WHEN c = 'status' THEN (SELECT count(*) - count(status) FROM t)
           ELSE (SELECT count(*) - count(priority) FROM t) END AS missing, u AS "unique", v AS most_common, n AS mode_count
         FROM r WHERE k = 1""",
)
def categorical_summary(spark, folder):
    return profile.categorical_summary(damaged_orders(spark, folder))


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing,
        round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
        round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_pct, CAST(0 AS BIGINT) AS outlier_count,
        round(100.0 - round((count(*) - count({c})) / count(*) * 100, 2), 2) AS completeness FROM {source}"""
        for i, (c, t) in enumerate(columns.items())
    )


EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string",
}


@REG.add("column_profile_events", _profile_sql("events", EVENT_TYPES))
def column_profile_events(spark, folder):
    return longs(profile.column_profile(table(spark, folder, "events")), "ordinal")


def _shape_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, avg(CASE WHEN abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c})) THEN 1.0 WHEN {c} IS NULL THEN NULL ELSE 0.0 END) AS i,
        avg(CASE WHEN {c} >= 0 THEN 1.0 WHEN {c} IS NULL THEN NULL ELSE 0.0 END) AS nn, avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NULL THEN NULL ELSE 0.0 END) AS pos,
        avg(CASE WHEN {c} BETWEEN 0 AND 100 THEN 1.0 WHEN {c} IS NULL THEN NULL ELSE 0.0 END) AS pct, skewness({c}) AS skew,
        count(DISTINCT {c}) AS d, count(*) AS rows_ FROM {source}"""
        for c in columns
    )


PROFILED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"]


@REG.add(
    "value_profile",
    f"""WITH s AS ({_shape_sql("lineitem", PROFILED)}) SELECT "column", n, round(i, 6) AS integer_rate, round(nn, 6) AS non_negative_rate,
        round(pos, 6) AS positive_rate, round(pct, 6) AS percentage_0_100_rate, round(skew, 4) AS skew, round(d / n, 6) AS unique_ratio,
        round(0.45 * i + 0.35 * nn + 0.20 * (1 - d / n), 6) AS count_like_score FROM s""",
)
def value_profile(spark, folder):
    out = profile.value_profile(table(spark, folder, "lineitem"), PROFILED).select(
        "column", "n", "integer_rate", "non_negative_rate", "positive_rate", "percentage_0_100_rate", "skew",
        "unique_ratio", "count_like_score",
    )
    return rounded(
        out, integer_rate=6, non_negative_rate=6, positive_rate=6, percentage_0_100_rate=6, skew=4, unique_ratio=6,
        count_like_score=6,
    )


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

ROLE_CASE = """CASE WHEN "column" IN ('l_quantity', 'l_discount') THEN 'quantity' WHEN "column" = 'l_extendedprice' THEN 'money'
  WHEN 0.45 * i + 0.35 * nn + 0.20 * (1 - d / n) >= 0.75 AND d / n <= 0.70 THEN 'count_like'
  WHEN pct >= 0.98 AND d / n > 0.10 AND n >= 10 THEN 'percentage_like'
  WHEN nn = 1 AND skew > 1.0 THEN 'positive_skewed' ELSE 'numeric' END"""


@REG.add(
    "numeric_roles",
    f"""WITH s AS ({_shape_sql("lineitem", LINE_NUMBERS)} UNION ALL {_shape_sql("events", ["event_id", "user_id", "value"])}),
        r AS (SELECT *, {ROLE_CASE} AS role FROM s)
        SELECT "column", role, CASE role WHEN 'quantity' THEN 0.95 WHEN 'money' THEN 0.95
          WHEN 'count_like' THEN round(0.45 * i + 0.35 * nn + 0.20 * (1 - d / n), 2) WHEN 'percentage_like' THEN 0.7
          WHEN 'positive_skewed' THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence FROM r""",
)
def numeric_roles(spark, folder):
    parts = [roles.role_table(table(spark, folder, name)) for name in ("lineitem", "events")]
    return parts[0].unionByName(parts[1]).select("column", "role", "confidence")


# Star-schema and event columns with the name hits that the rules look for, worked out by hand.
# name, integer?, first column?, identifier name?, geographic name?, kind
NAMED_COLUMNS = [
    ("orders", "o_orderkey", "i", 1, 1, 0), ("orders", "o_custkey", "i", 0, 1, 0), ("orders", "o_orderstatus", "t", 0, 0, 0),
    ("orders", "o_totalprice", "n", 0, 0, 0), ("orders", "o_orderdate", "d", 0, 0, 0), ("orders", "o_orderpriority", "t", 0, 0, 0),
    ("events", "event_id", "i", 1, 1, 0), ("events", "ts", "d", 0, 0, 0), ("events", "user_id", "i", 0, 1, 0),
    ("events", "event_type", "t", 0, 0, 0), ("events", "value", "n", 0, 0, 0), ("events", "props", "t", 0, 0, 0),
    ("customer", "c_custkey", "i", 1, 1, 0), ("customer", "c_name", "t", 0, 0, 0), ("customer", "c_nationkey", "i", 0, 1, 1),
    ("customer", "c_acctbal", "n", 0, 0, 0), ("customer", "c_mktsegment", "t", 0, 0, 0),
    ("labels", "doc_id", "i", 1, 1, 0), ("labels", "quality", "i", 0, 0, 0), ("labels", "toxic", "i", 0, 0, 0),
]


def _facts_sql() -> str:
    parts = []
    for source, c, kind, first, named, geo in NAMED_COLUMNS:
        steps = "0.0"
        if kind == "i":
            steps = (
                f"(SELECT CASE WHEN count(*) > 10 THEN sum(CASE WHEN v - p = 1 THEN 1.0 ELSE 0.0 END) / (count(*) - 1) ELSE 0 END FROM "
                f"(SELECT {c} AS v, lag({c}) OVER (ORDER BY {c}) AS p FROM {source} WHERE {c} IS NOT NULL))"
            )
        low = f"min({c})" if kind in "in" else "NULL"
        high = f"max({c})" if kind in "in" else "NULL"
        parts.append(
            f"""SELECT '{source}' AS source, '{c}' AS "column", '{kind}' AS kind, {first} AS first, {named} AS named, {geo} AS geo,
            count(DISTINCT {c}) AS d, count(*) AS n, {steps} AS steps, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM {source}"""
        )
    return " UNION ALL ".join(parts)


IDENTIFIER = "(named = 1 AND d / n > 0.9) OR (kind = 'i' AND steps > 0.9) OR (first = 1 AND d / n > 0.95)"


def _named_facts(spark, folder):
    out = []
    for source in dict.fromkeys(s for s, *_ in NAMED_COLUMNS):
        frame = table(spark, folder, source)
        out.append((source, frame, roles.column_facts(frame, frame.columns[:1])))
    return out


@REG.add("identifier_columns", f"""WITH f AS ({_facts_sql()}) SELECT source, "column", ({IDENTIFIER}) AS is_identifier FROM f""")
def identifier_columns(spark, folder):
    rows = [(s, f.column, roles.is_identifier(f)) for s, _, fs in _named_facts(spark, folder) for f in fs]
    return spark.createDataFrame(rows, "source string, column string, is_identifier boolean")


@REG.add(
    "outlier_excluded_columns",
    f"""WITH f AS ({_facts_sql()}), s AS ({_shape_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"])}
        UNION ALL {_shape_sql("events", ["event_id", "user_id", "value"])} UNION ALL {_shape_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"])})
        SELECT f.source, f."column", CASE WHEN f."column" IN ('o_totalprice') THEN false
          WHEN 0.45 * i + 0.35 * nn + 0.20 * (1 - s.d / s.n) >= 0.75 AND s.d / s.n <= 0.70 THEN false
          WHEN ({IDENTIFIER.replace("d / n", "f.d / f.n")}) THEN true ELSE f."column" IN ('event_id') END AS outlier_excluded
        FROM f JOIN s ON f."column" = s."column" WHERE f.source IN ('orders', 'events', 'customer')""",
)
def outlier_excluded_columns(spark, folder):
    rows = [
        (s, f.column, roles.is_outlier_excluded(f))
        for s, _, fs in _named_facts(spark, folder)
        if s in ("orders", "events", "customer")
        for f in fs
        if f.numeric
    ]
    return spark.createDataFrame(rows, "source string, column string, outlier_excluded boolean")


@REG.add(
    "column_categories",
    f"""WITH f AS ({_facts_sql()}) SELECT source, "column", CASE WHEN {IDENTIFIER} THEN 'identifiers'
          WHEN kind = 'i' AND lo >= 0 AND hi <= 1 THEN 'other' WHEN kind = 'd' THEN 'temporal' WHEN geo = 1 THEN 'geographic'
          WHEN kind IN ('i', 'n') THEN 'metrics' WHEN d BETWEEN 2 AND 50 OR d / n < 0.05 THEN 'dimensions' ELSE 'other' END AS category FROM f""",
)
def column_categories(spark, folder):
    rows = [(s, f.column, roles.category(f)) for s, _, fs in _named_facts(spark, folder) for f in fs]
    return spark.createDataFrame(rows, "source string, column string, category string")


@REG.add(
    "key_candidates",
    """WITH c AS (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, count(*) AS n FROM orders
        UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM orders
        UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) FROM orders
        UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), count(*) FROM orders
        UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), count(*) FROM orders
        UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders)
       SELECT c AS "column", CASE WHEN d = n THEN 'primary_key' ELSE 'foreign_key' END AS key_type,
         CASE WHEN d = n THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence,
         CASE WHEN d = n THEN c || ': every row has its own value' ELSE c || ': values repeat as references do' END AS insight
       FROM c WHERE d = n OR (d / n > 0.1 AND d / n < 0.9)""",
)
def key_candidates(spark, folder):
    return profile.key_candidates(table(spark, folder, "orders"))


@REG.add(
    "suggest_aggregations",
    """WITH m AS (SELECT * FROM (VALUES ('l_orderkey', 1), ('l_partkey', 2), ('l_suppkey', 3), ('l_linenumber', 4), ('l_quantity', 5), ('l_extendedprice', 6),
         ('l_discount', 7), ('l_tax', 8)) v(metric, i)),
       g AS (SELECT 'l_returnflag' AS dimension, 1 AS j, count(DISTINCT l_returnflag) AS d FROM lineitem
             UNION ALL SELECT 'l_linestatus', 2, count(DISTINCT l_linestatus) FROM lineitem)
       SELECT 'Sum ' || metric || ' by ' || dimension AS aggregation, metric, dimension, 'group_sum' AS type, 'bar' AS chart_suggestion
       FROM m, g WHERE d BETWEEN 2 AND 50 ORDER BY i, j""",
)
def suggest_aggregations(spark, folder):
    lines = table(spark, folder, "lineitem")
    rows = roles.suggest_aggregations(roles.column_facts(lines, ["l_orderkey"]))
    names = ["aggregation", "metric", "dimension", "type", "chart_suggestion"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


@REG.add(
    "dashboard_columns",
    """WITH v AS (SELECT 'value' AS c, var_samp(value) AS v, 4 AS o FROM events UNION ALL SELECT 'user_id', var_samp(user_id), 2 FROM events),
       m AS (SELECT c, row_number() OVER (ORDER BY v DESC, o) AS p FROM v),
       d AS (SELECT 'event_type' AS c, 10 AS p, count(DISTINCT event_type) AS d, count(*) AS n FROM events
             UNION ALL SELECT 'props', 11, count(DISTINCT props), count(*) FROM events),
       a AS (SELECT c, p FROM m UNION ALL SELECT c, p FROM d WHERE d BETWEEN 2 AND 50 OR d / n < 0.05 UNION ALL SELECT 'ts', 20)
       SELECT row_number() OVER (ORDER BY p) AS position, c AS "column" FROM a""",
)
def dashboard_columns(spark, folder):
    events = table(spark, folder, "events")
    chosen = roles.dashboard_columns(roles.column_facts(events, ["event_id"]))
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "position long, column string")


@REG.add(
    "primary_metric",
    """WITH s AS (SELECT 'value' AS c, 3.0 + count(value) / count(*) + count(DISTINCT value) / count(value) + least(var_samp(value), 1) AS score FROM events
        UNION ALL SELECT 'user_id', count(user_id) / count(*) + count(DISTINCT user_id) / count(user_id) + least(var_samp(user_id), 1) FROM events)
       SELECT c AS metric, round(score, 4) AS score FROM s ORDER BY score DESC, c LIMIT 1""",
)
def primary_metric(spark, folder):
    facts = roles.column_facts(table(spark, folder, "events"), ["event_id"])
    best = roles.primary_metric(facts)
    score = next(roles.primary_score(f) for f in facts if f.column == best)
    return spark.createDataFrame([(best, round(score, 4))], "metric string, score double")


@REG.add(
    "analysis_confidence",
    f"""WITH t AS (SELECT customer, amount, placed, status, priority FROM ({DAMAGED_SQL})),
        r AS (SELECT round(abs(corr(l_quantity, l_extendedprice)), 3) AS s FROM lineitem),
        f AS (SELECT 1 - (3 * count(*) - count(amount) - count(status) - count(priority)) / (count(*) * 5) AS c FROM t)
        SELECT round(CASE WHEN s > 0.5 THEN s * 0.7 + c * 0.3 ELSE 0.5 END, 2) AS confidence FROM r, f""",
)
def analysis_confidence(spark, folder):
    orders = damaged_orders(spark, folder).drop("row_id")
    found = stats.pearson_pairs(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return relations.analysis_confidence(orders, found)


@REG.add(
    "sample_values",
    """WITH u AS (SELECT DISTINCT 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part
                  UNION ALL SELECT DISTINCT 'p_name', p_name FROM part),
       k AS (SELECT *, count(*) OVER (PARTITION BY c) AS d, row_number() OVER (PARTITION BY c ORDER BY v) AS p FROM u WHERE v IS NOT NULL)
       SELECT c AS "column", p AS position, v AS value FROM k WHERE d BETWEEN 2 AND 50 AND p <= 15""",
)
def sample_values(spark, folder):
    return longs(profile.sample_values(table(spark, folder, "part")), "position")
