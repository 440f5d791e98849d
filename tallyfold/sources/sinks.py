"""Writing tables: new copies, versioned replacement, append-only logs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.tables import latest_per_key

POINTER = "dataset string, version long, path string, created_at timestamp"
LOG = (
    "dataset_id string, profile_id string, rows_before long, rows_after long, duplicates_removed long, "
    "missing_handled long, outliers_detected long, types_fixed long, report_json string"
)


def save_new(df: DataFrame, path: str, file_type: str = "parquet") -> str:
    """Writes a new dataset; an existing path is an error."""
    writer = df.write.mode("errorifexists")
    if file_type == "csv":
        # Quotes inside quotes are doubled and blanks kept, so that ``read_csv`` gives back what was written.
        plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**plain).csv(path)
    elif file_type in ("json", "parquet"):
        getattr(writer, file_type)(path)
    else:
        raise ValueError(f"unsupported file type {file_type}")
    return path


def cleaned_name(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/cleaned_{name}" if folder else f"cleaned_{name}"


class VersionTaken(RuntimeError):
    """Another writer has claimed the next version."""


def replace_version(df: DataFrame, root: str, dataset: str, pointers: str, file_type: str = "parquet") -> str:
    """Writes the next version beside the current one, then moves the pointer by appending a row.

    The next version is claimed by creating its folder, which only one writer can do; the others fail before they write anything. The
    version being read is never overwritten, the former one stays as the backup, and a job that dies half-way leaves the pointer where it
    was; the version it claimed is passed over by later ones."""
    spark = df.sparkSession
    folder = f"{root.rstrip('/')}/{dataset}"
    version = _claim(spark, folder, _pointer(spark, pointers, dataset))
    path = save_new(df, f"{folder}/v{version:06d}/data", file_type)
    row = spark.createDataFrame([(dataset, version, path)], "dataset string, version long, path string")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(pointers)
    return path


def _claim(spark: SparkSession, folder: str, current: Row | None) -> int:
    """The number after the current version and all that were claimed and given up. Creating its marker fails if it exists."""
    files, root = _file_system(spark, folder)
    files.mkdirs(root)
    names = [s.getPath().getName() for s in files.listStatus(root)]
    started = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    done = current["version"] if current else 0
    given_up = [v for v in started if v > done and files.exists(_path(spark, f"{folder}/v{v:06d}/abandoned"))]
    version = max([done, *given_up]) + 1
    files.mkdirs(_path(spark, f"{folder}/v{version:06d}"))
    try:
        files.create(_path(spark, f"{folder}/v{version:06d}/claim"), False).close()
    except Py4JJavaError as error:
        raise VersionTaken(f"version {version} of {folder} is being written by another job; call abandon() if that job died") from error
    return version


def abandon(spark: SparkSession, root: str, dataset: str, pointers: str) -> None:
    """Gives up the version that a dead job has claimed, so that the next writer takes the one after it."""
    folder = f"{root.rstrip('/')}/{dataset}"
    files, _ = _file_system(spark, folder)
    current = _pointer(spark, pointers, dataset)
    version = (current["version"] if current else 0) + 1
    while files.exists(_path(spark, f"{folder}/v{version:06d}/abandoned")):
        version += 1
    if files.exists(_path(spark, f"{folder}/v{version:06d}/claim")):
        files.create(_path(spark, f"{folder}/v{version:06d}/abandoned"), False).close()


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _file_system(spark: SparkSession, text: str):
    path = _path(spark, text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_path(spark: SparkSession, pointers: str, dataset: str) -> str | None:
    row = _pointer(spark, pointers, dataset)
    return row["path"] if row else None


def _pointer(spark: SparkSession, pointers: str, dataset: str) -> Row | None:
    files, path = _file_system(spark, pointers)
    if not files.exists(path):
        return None
    table = spark.read.schema(POINTER).parquet(pointers)
    return latest_per_key(table.filter(F.col("dataset") == dataset), ["dataset"], [F.desc("version")]).first()


def append_log(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Appends cleaning log rows with the time of writing."""
    table = spark.createDataFrame(rows, LOG).withColumn("created_at", F.current_timestamp())
    table.coalesce(1).write.mode("append").parquet(path)
