"""Metadata tables: pages, histories, latest rows, ownership counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numbers import without_nan


def preview(df: DataFrame, order_by: list[str], limit: int = 50) -> DataFrame:
    """First rows in a given order, NaN shown as null."""
    return without_nan(df).orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(limit)


def page(df: DataFrame, newest: str, tie: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the newest-first order; the sort is bounded by their sum."""
    return df.orderBy(F.desc(newest), tie).offset(skip).limit(limit)


def owner_page(df: DataFrame, owner: Column, newest: str, tie: str, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(df.filter(owner), newest, tie, skip, limit)


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order. The rank limit also runs before the shuffle, so at most one
    row per key and task is moved and a hot key is no bottleneck."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter("_rn = 1").drop("_rn")


def latest_with_metadata(logs: DataFrame, dataset: str, created: str, metadata: str) -> DataFrame:
    """Newest log row per dataset among those that carry metadata."""
    return latest_per_key(logs.filter(F.col(metadata).isNotNull()), [dataset], [F.desc(created)])


def owner_counts(datasets: DataFrame, dashboards: DataFrame, dataset_id: str, owner: str, kpis: str) -> DataFrame:
    """Datasets, dashboards and figures (length of a JSON array) per owner.

    Dashboards are reduced to one row per dataset first, so the join never multiplies rows."""
    per_dataset = dashboards.groupBy(dataset_id).agg(
        F.count(F.lit(1)).alias("_dashboards"),
        F.sum(F.coalesce(F.json_array_length(kpis), F.lit(0))).alias("_kpis"),
    )
    return (
        datasets.join(per_dataset, dataset_id, "left")
        .groupBy(owner)
        .agg(
            F.count(F.lit(1)).alias("datasets"),
            F.coalesce(F.sum("_dashboards"), F.lit(0)).alias("dashboards"),
            F.coalesce(F.sum("_kpis"), F.lit(0)).alias("kpis"),
        )
    )


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Which column names two tables share and which only one has."""
    spark = left.sparkSession
    a = spark.createDataFrame([(c,) for c in left.columns], "column string")
    b = spark.createDataFrame([(c,) for c in right.columns], "column string")
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.exceptAll(b).withColumn("side", F.lit("left")))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )
