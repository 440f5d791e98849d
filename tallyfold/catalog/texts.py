"""Retrieval and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.catalog.base import Registry, longs, rounded, table
from tallyfold.catalog.profiles import EVENT_TYPES, _profile_sql
from tallyfold.functions.text import source_version
from tallyfold.operators import profile, retrieval, turns

REG = Registry()

QUESTION = "the of and that with ering"
WORDS = "list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))"


@REG.add(
    "lexical_topk",
    f"""WITH s AS (SELECT doc_id, lang, len(list_intersect({WORDS}, ['the', 'of', 'and', 'that', 'with', 'ering'])) AS score FROM documents)
        SELECT doc_id, lang, CAST(score AS BIGINT) AS score FROM s ORDER BY score DESC, doc_id LIMIT 6""",
)
def lexical_topk(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return longs(retrieval.lexical_topk(documents, "text", QUESTION, "doc_id"), "score").drop("text")


@REG.add(
    "column_fact_chunks",
    f"""WITH p AS ({_profile_sql("events", EVENT_TYPES)}), v AS (SELECT left(sha1('7:2024-01-01'), 12) AS v)
        SELECT 'ds7_col_' || "column" || '_' || v AS chunk_id, 'column_fact' AS chunk_type,
          'column ' || "column" || ' (' || dtype || '); missing ' || missing_pct || '; distinct ' || "unique" AS text,
          v AS source_version FROM p, v""",
)
def column_fact_chunks(spark, folder):
    version = source_version(F.lit("7"), F.lit("2024-01-01"))
    return retrieval.column_chunks(profile.column_profile(table(spark, folder, "events")), "7", version)


@REG.add(
    "upsert_chunks",
    """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang ELSE lang END AS text FROM documents""",
)
def upsert_chunks(spark, folder):
    old = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("text"))
    new = old.filter("chunk_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return retrieval.upsert_chunks(old, new)


def _vector(spark, folder, vec_id: int) -> list[float]:
    return table(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def _distance(vec_id: int) -> str:
    return f"""1 - list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q{vec_id}.embedding AS DOUBLE[])), lambda p: p[1] * p[2]))
      / (sqrt(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(q{vec_id}.embedding AS DOUBLE[]), lambda x: x * x))))"""


def _query(vec_id: int) -> str:
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q{vec_id}"


@REG.add(
    "cosine_topk",
    f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT e.vec_id, e.label, {_distance(3)} AS d FROM embeddings e, {_query(3)}) ORDER BY d, vec_id LIMIT 16",
)
def cosine_topk(spark, folder):
    found = retrieval.cosine_topk(table(spark, folder, "embeddings"), "embedding", _vector(spark, folder, 3), "vec_id", 16)
    return rounded(found.drop("embedding"), distance=6)


@REG.add(
    "cosine_diverse",
    f"""WITH s AS (SELECT vec_id, label, d FROM (SELECT e.vec_id, e.label, {_distance(3)} AS d FROM embeddings e, {_query(3)}) WHERE d IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM s)
        SELECT vec_id, label, round(d, 6) AS distance FROM r WHERE k <= 2 ORDER BY d, vec_id LIMIT 8""",
)
def cosine_diverse(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    found = retrieval.diverse_topk(embeddings, "embedding", _vector(spark, folder, 3), "vec_id", "label", 8)
    return rounded(found.drop("embedding"), distance=6)


@REG.add(
    "cosine_filtered",
    " UNION ALL ".join(
        f"""(SELECT '{name}' AS topic, vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) AS position
        FROM (SELECT e.vec_id, {_distance(q)} AS d FROM embeddings e, {_query(q)} WHERE e.label = {label}) ORDER BY d, vec_id LIMIT {k})"""
        for name, q, label, k in (("facts", 3, 1, 5), ("metrics", 11, 2, 3), ("rules", 20, 1, 2))
    ),
)
def cosine_filtered(spark, folder):
    topics = [
        ("facts", _vector(spark, folder, 3), "1", 5),
        ("metrics", _vector(spark, folder, 11), "2", 3),
        ("rules", _vector(spark, folder, 20), "1", 2),
    ]
    found = retrieval.topic_topk(table(spark, folder, "embeddings"), "embedding", topics, "vec_id", "label")
    return rounded(longs(found.select("topic", "vec_id", "distance", "position"), "position"), distance=6)


@REG.add("source_version", "SELECT o_orderkey, left(sha1(o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d')), 12) AS version FROM orders")
def source_version_(spark, folder):
    version = source_version(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, folder, "orders").select("o_orderkey", version.alias("version"))


BLANK = r"' \t\n\r'"
TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@REG.add(
    "merge_turns",
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS role, text FROM conversations),
        s AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS st FROM c),
        i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS isl FROM s)
        SELECT conv_id, min(turn) AS first_turn, min(role) AS role, count(*) AS turns,
          string_agg(coalesce(nullif({TRIM.format("text")}, ''), '(empty message)'), chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, isl""",
)
def merge_turns(spark, folder):
    """The table has no neighbours of one role, so some turns change role first."""
    talks = table(spark, folder, "conversations")
    changed = talks.withColumn("role", F.when(F.col("turn") % 4 == 3, "user").otherwise(F.col("role")))
    return turns.merge_turns(changed)


def _line(limit: int) -> str:
    flat = f"replace({TRIM.format('text')}, chr(10), ' ')"
    return f"role || ': ' || CASE WHEN length({flat}) > {limit} THEN left({flat}, {limit}) || '…' ELSE {flat} END"


@REG.add(
    "transcript_tail",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
        SELECT conv_id, string_agg({_line(600)}, chr(10) ORDER BY turn) AS transcript FROM r WHERE k <= 4 GROUP BY 1""",
)
def transcript_tail(spark, folder):
    return turns.transcript_tail(table(spark, folder, "conversations"), 4)


@REG.add(
    "contextual_query",
    f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c),
        h AS (SELECT a.conv_id, a.turn, {TRIM.format("a.text")} AS m, string_agg(b.line, chr(10) ORDER BY b.p) AS hist FROM n a
              LEFT JOIN (SELECT conv_id, p, {_line(320)} AS line FROM n) b ON a.conv_id = b.conv_id AND b.p < a.p AND b.p >= a.p - 8
              WHERE a.role = 'user' GROUP BY 1, 2, 3)
        SELECT conv_id, turn, CASE WHEN length(m) >= 100 OR hist IS NULL THEN m ELSE hist || chr(10) || 'user: ' || m END AS query FROM h""",
)
def contextual_query(spark, folder):
    return turns.contextual_query(table(spark, folder, "conversations"))


ASKED = """SELECT conv_id, turn, role, CASE WHEN turn % 4 = 2 THEN 'please show a chart of it' WHEN turn % 7 = 3 THEN 'compare sales by month and how they relate' ELSE text END AS text FROM conversations"""  # noqa: E501


def _asked(spark, folder):
    """Conversations with some turns turned into chart requests and comparisons."""
    asked = (
        F.when(F.col("turn") % 4 == 2, "please show a chart of it")
        .when(F.col("turn") % 7 == 3, "compare sales by month and how they relate")
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").withColumn("text", asked)


CHART, COMPARE, RELATE = turns.CHART_REQUEST, turns.COMPARISON, turns.RELATION


@REG.add(
    "intent_flags",
    f"""WITH c AS ({ASKED}) SELECT conv_id, turn, regexp_matches(text, '{CHART}') AS wants_chart, regexp_matches(text, '{COMPARE}') AS compares,
        regexp_matches(text, '{RELATE}') AS asks_relation FROM c""",
)
def intent_flags(spark, folder):
    return turns.intent_flags(_asked(spark, folder)).select("conv_id", "turn", "wants_chart", "compares", "asks_relation")


@REG.add(
    "last_question",
    f"""WITH c AS ({ASKED}), f AS (SELECT *, regexp_matches(text, '{CHART}') AS ch FROM c),
        q AS (SELECT *, last_value(CASE WHEN role = 'user' AND length({TRIM.format("text")}) > 15 AND NOT ch THEN {TRIM.format("text")} END IGNORE NULLS)
          OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f)
        SELECT conv_id, turn, CASE WHEN ch THEN coalesce(prev, text) ELSE text END AS question FROM q WHERE role = 'user'""",
)
def last_question(spark, folder):
    return turns.last_question(_asked(spark, folder))


@REG.add(
    "dedup_host",
    """WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages),
       r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM h WHERE host <> '')
       SELECT page_id, host FROM r WHERE k = 1""",
)
def dedup_host(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))
    return retrieval.first_seen(pages, F.col("host"), "page_id")
