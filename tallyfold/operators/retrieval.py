"""Text and vector retrieval over described columns and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import source_version, tokens
from tallyfold.functions.vectors import distance_to
from tallyfold.operators.tables import latest_per_key

# Fixed values of retrieval.
PER_TYPE = 2


def lexical_topk(df: DataFrame, text: str, query: str, order_by: str, top_k: int = 6) -> DataFrame:
    """Texts sharing most distinct words with the query; ties and empty queries follow ``order_by``.

    The query's words are a literal, so scoring is a projection and the result a bounded sort."""
    wanted = tokens(F.lit(query))
    score = F.size(F.array_intersect(tokens(F.coalesce(F.col(text), F.lit(""))), wanted))
    return df.withColumn("score", score).orderBy(F.desc("score"), order_by).limit(top_k)


def cosine_topk(df: DataFrame, vector: str, query: list[float], order_by: str, top_k: int = 8) -> DataFrame:
    """Nearest rows by exact cosine distance; rows whose vector has another length are left out."""
    distance = distance_to(F.col(vector), query)
    return df.withColumn("distance", distance).filter("distance is not null").orderBy("distance", order_by).limit(top_k)


def diverse_topk(
    df: DataFrame, vector: str, query: list[float], order_by: str, chunk_type: str, top_k: int = 8
) -> DataFrame:
    """The nearest ``top_k`` rows with at most two per type, ranked within their type over all rows."""
    fetched = df.withColumn("distance", distance_to(F.col(vector), query)).filter("distance is not null")
    by_type = Window.partitionBy(F.coalesce(F.col(chunk_type).cast("string"), F.lit("other"))).orderBy("distance", order_by)
    capped = fetched.withColumn("_rn", F.row_number().over(by_type)).filter(F.col("_rn") <= PER_TYPE).drop("_rn")
    return capped.orderBy("distance", order_by).limit(top_k)


def topic_topk(
    df: DataFrame, vector: str, topics: list[tuple[str, list[float], str, int]], order_by: str, chunk_type: str
) -> DataFrame:
    """Nearest rows of each topic ``(name, query vector, chunk type, k)`` among the rows of its type.

    One scan serves all topics; the rank limit also runs before the shuffle, so a task sends at most k
    rows per topic."""
    cells = [
        F.when(
            F.col(chunk_type).cast("string") == F.lit(kind),
            F.struct(
                F.lit(name).alias("topic"),
                F.lit(k).alias("_k"),
                distance_to(F.col(vector), query).alias("distance"),
            ),
        )
        for name, query, kind, k in topics
    ]
    kinds = [kind for _, _, kind, _ in topics]
    wanted = df.filter(F.col(chunk_type).cast("string").isin(kinds))
    found = wanted.select("*", F.inline(F.array_compact(F.array(*cells))))
    most = max(k for _, _, _, k in topics)
    place = F.row_number().over(Window.partitionBy("topic").orderBy("distance", order_by))
    ranked = found.withColumn("position", place).filter(F.col("position") <= most)
    return ranked.filter(F.col("position") <= F.col("_k")).drop("_k")


def column_chunks(profile: DataFrame, dataset: str, version: Column) -> DataFrame:
    """One chunk per column of a ``column_profile``: name, type, missing share, distinct values."""
    text = F.format_string("column %s (%s); missing %s; distinct %s", "column", "dtype", F.col("missing_pct").cast("string"), F.col("unique").cast("string"))
    chunk_id = F.concat(F.lit(f"ds{dataset}_col_"), "column", F.lit("_"), version)
    return _chunks(profile, chunk_id, "column_fact", text, version)


def relationship_chunks(relationships: DataFrame, dataset: str, version: Column, most: int | None = None) -> DataFrame:
    """One chunk for each relationship, or for the ``most`` strongest; there is one row per pair of columns to number."""
    order = [F.desc("strength"), "col_a", "col_b"]
    kept = relationships if most is None else relationships.orderBy(*order).limit(most)
    text = F.format_string(
        "%s with %s: %s; strength %s; by %s", "col_a", "col_b", F.coalesce("type", F.lit("none")),
        F.coalesce(F.col("strength").cast("string"), F.lit("none")), F.coalesce("method", F.lit("none")),
    )
    numbered = kept.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    chunk_id = F.concat(F.lit(f"ds{dataset}_rel_"), "_at", F.lit("_"), version)
    return _chunks(numbered, chunk_id, "relationship", text, version)


def definition_chunks(
    spark: SparkSession, dataset: str, version: Column, primary: str | None, groups: dict[str, list[str]], rules: list[str] | None = None
) -> DataFrame:
    """The metric definition chunk and, if the caller has rules for answers, a chunk of them."""
    parts = {"primary": primary or "none"} | {k: ", ".join(groups.get(k, [])) or "none" for k in ("metrics", "dimensions", "temporal")}
    chunks = [("metrics", "metric_definition", "\n".join(f"{k} = {v}" for k, v in parts.items()))]
    if rules:
        chunks.append(("guardrails", "guardrail", "\n".join(rules)))
    rows = spark.createDataFrame(chunks, "part string, kind string, body string")
    chunk_id = F.concat(F.lit(f"ds{dataset}_"), "part", F.lit("_"), version)
    return _chunks(rows, chunk_id, F.col("kind"), F.col("body"), version)


def _chunks(df: DataFrame, chunk_id: Column, kind, text: Column, version: Column) -> DataFrame:
    kind_column = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        chunk_id.alias("chunk_id"), kind_column.alias("chunk_type"), text.alias("text"), version.alias("source_version")
    )


def build_chunks(
    df: DataFrame, dataset: str, profile: DataFrame, relationships: DataFrame, primary: str | None,
    groups: dict[str, list[str]], updated: str, rules: list[str] | None = None,
) -> DataFrame:
    version = source_version(F.lit(dataset), F.lit(updated))
    parts = [
        column_chunks(profile, dataset, version),
        relationship_chunks(relationships, dataset, version),
        definition_chunks(df.sparkSession, dataset, version, primary, groups, rules),
    ]
    return reduce(DataFrame.unionByName, parts)


def upsert_chunks(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Union by id, the newer write wins."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return latest_per_key(both, [key], [F.col("_age")]).drop("_age")


def first_seen(df: DataFrame, key: Column, order_by: str) -> DataFrame:
    """First row of each non-empty key in the given order."""
    keyed = df.withColumn("_key", key).filter("_key is not null and _key <> ''")
    return latest_per_key(keyed, ["_key"], [F.col(order_by)]).drop("_key")
