"""Files arriving in a folder: each micro-batch is stored, profiled and scanned, stage by stage.

The stream keeps no state. A batch is stored once, under a folder of its own for every attempt; the other stages read what was stored. When an attempt
is done, one file in the manifest says where its results lie, and readers take the last such attempt of every batch. So a
batch that is run again after a failure replaces its earlier results for every reader at once, nothing is counted twice, and what a
failed attempt left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyfold.operators.profile import column_profile
from tallyfold.operators.scan import scan

Stage = Callable[[DataFrame], DataFrame]

# The stage that stores the rows; the others only report on them.
STORAGE = "rows"
_MANIFEST = "status"


def default_stages(row_key: str) -> dict[str, Stage]:
    return {
        STORAGE: lambda df: df,
        "profile": column_profile,
        "issues": lambda df: scan(df, row_key),
    }


MANIFEST = "batch long, attempt string, stage string, path string, status string, finished_at timestamp"


def run_stages(batch: DataFrame, batch_id: int, target: str, stages: dict[str, Stage]) -> dict[str, str]:
    """Runs each stage on its own, the reports on the stored rows; the manifest says which ones failed and why. If the rows themselves could not be
    stored, the batch fails once that is written, so that it is not committed and is run again."""
    spark = batch.sparkSession
    attempt = uuid.uuid4().hex
    path = lambda name: f"{target}/{name}/batch={batch_id}/attempt={attempt}"
    status = {}
    lost = None
    kept = batch
    for name, stage in sorted(stages.items(), key=lambda x: x[0] != STORAGE):
        try:
            out = stage(kept)
            out.write.mode("errorifexists").parquet(path(name))
            status[name] = "done"
            if name == STORAGE:
                kept = spark.read.schema(out.schema).parquet(path(name))
        except Exception as error:  # noqa: BLE001 - one stage's failure must not stop the others
            status[name] = f"failed: {type(error).__name__}: {str(error)[:200]}"
            if name == STORAGE:
                lost = error
                break
    rows = [(batch_id, attempt, name, path(name), text) for name, text in status.items()]
    report = spark.createDataFrame(rows, "batch long, attempt string, stage string, path string, status string")
    report.withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{target}/{_MANIFEST}")
    if lost is not None:
        raise lost
    return status


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The valid results: of each batch the last attempt whose rows were stored, one row per stage."""
    entries = spark.read.schema(MANIFEST).parquet(f"{target}/{_MANIFEST}")
    stored = entries.filter((F.col("stage") == STORAGE) & (F.col("status") == "done"))
    valid = stored.groupBy("batch").agg(F.max_by("attempt", F.struct("finished_at", "attempt")).alias("attempt"))
    return entries.join(valid, ["batch", "attempt"])


def read_stage(spark: SparkSession, target: str, stage: str, schema: StructType | None = None) -> DataFrame:
    """What a stage has written for all batches, each batch once."""
    done = manifest(spark, target).filter((F.col("stage") == stage) & (F.col("status") == "done"))
    paths = [r["path"] for r in done.select("path").orderBy("path").collect()]  # one per batch
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def ingest_folder(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    row_key: str,
    file_format: str = "parquet",
    max_files: int = 1_000,
    stages: dict[str, Stage] | None = None,
) -> StreamingQuery:
    """Processes what is in the folder now and stops; run it again for files that came later."""
    chosen = stages or default_stages(row_key)
    files = (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", f"*.{file_format}")
        .load(source)
    )
    return (
        files.writeStream.foreachBatch(lambda batch, number: run_stages(batch, number, target, chosen) and None)
        .option("checkpointLocation", f"{target}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
