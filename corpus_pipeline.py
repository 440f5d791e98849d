"""From raw documents to packed training windows: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm import mixing, order_minhash, packing, quality, surrogates
from tallyfold.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-copies the document with the least id stays; rows without an id all stay. Of rows that repeat the kept id the one with the
    least hash of its text, then of all its columns, stays, in whatever order they come."""
    columns = docs.columns
    classes = order_minhash.near_copies(docs)
    kept = classes.filter("doc_id = class_id").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    first = docs.join(kept, "doc_id", "left_semi").withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return first.select([f"`{c}`" for c in columns]).unionByName(docs.filter("doc_id IS NULL"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; ``n_chars`` follows the new text."""
    replaced = surrogates.replace(docs)
    if "n_chars" not in docs.columns:
        return replaced
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return replaced.withColumn("n_chars", length.cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; repeats are rows."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("packing", packed),
]
#: SQL cannot say hashing into buckets, alignment or packing; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of a folder; each but the last is stored in the shared folder. One row per piece of a document in a
    packed sequence. Null, empty and very long texts, repeated rows and other columns are handled by each stage as it says; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
