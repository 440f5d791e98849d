"""Reading tables: CSV of unknown delimiter, JSON, Parquet, and tagged markdown texts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.numbers import NUMBER_TEXT
from tallyfold.plans.ordering import attach

# Delimiters that are tried, and how many lines are looked at.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 100

INTEGER_TEXT = r"^\s*[+-]?\d{1,18}\s*$"
BOOLEAN_TEXT = r"(?i)^\s*(true|false)\s*$"


def read_table(spark: SparkSession, path: str, file_type: str | None = None, **options) -> DataFrame:
    """Reads csv, json or parquet; the type is taken from the file name when not given."""
    kind = (file_type or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        return read_json(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type {kind}")


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None, **options) -> DataFrame:
    """JSON lines, or files holding one array of records. Lines can be split over tasks, arrays cannot; which
    of the two it is shows in the first line unless given."""
    if multi_line is None:
        head = spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").alias("line")).first()
        multi_line = head is not None and not (head["line"].startswith("{") and head["line"].endswith("}"))
    return spark.read.json(path, multiLine=multi_line, **options)


def sniff_delimiter(spark: SparkSession, path: str, lines: int = SNIFF_LINES) -> str:
    """The candidate that occurs in every sampled line, most evenly and most often; what stands in quotes does not count."""
    head = spark.read.text(path).limit(lines).filter("trim(value) <> ''")
    head = head.withColumn("value", F.regexp_replace("value", r'"[^"]*("|$)', ""))
    per_line = [
        (F.length("value") - F.length(F.replace("value", F.lit(d)))).cast("double").alias(f"d{i}")
        for i, d in enumerate(DELIMITERS)
    ]
    row = head.select(*per_line).agg(
        *[
            x
            for i in range(len(DELIMITERS))
            for x in (
                F.avg(f"d{i}").alias(f"mean{i}"),
                F.coalesce(F.stddev_pop(f"d{i}"), F.lit(0.0)).alias(f"dev{i}"),
                F.min(f"d{i}").alias(f"min{i}"),
            )
        ]
    ).first()
    def rank(i: int) -> tuple:
        in_every_line = (row[f"min{i}"] or 0) > 0
        return (not in_every_line, row[f"dev{i}"] / row[f"mean{i}"], -row[f"mean{i}"])

    present = [i for i in range(len(DELIMITERS)) if (row[f"mean{i}"] or 0) > 0]
    return DELIMITERS[min(present, key=rank)] if present else ","


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, one text each with the line breaks that stand in quotes: ``file``, ``block`` and ``line`` (where it starts), ``record``.

    Files are read in splits, each as lines. A line starts a record if the quotes before it in its file are even in number: the
    quotes of every split are counted in one read, their sums carried from split to split, and the second read knows of each line whether it lies inside
    quotes. Only lines of records with several lines are brought together, by the place where their record starts."""
    # Lines end at line feeds alone, so a carriage return inside quotes stays what it is.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # Where records start in a split that begins inside quotes, and in one that begins outside.
    ends = lines.mapInArrow(_marked_lines, MARKED).groupBy("file", "block").agg(
        F.max("quotes").alias("quotes"),
        F.max(F.when(F.col("inside") == 0, F.col("line"))).alias("last_if_out"),
        F.max(F.when(F.col("inside") == 1, F.col("line"))).alias("last_if_in"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("open", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
    last = F.when(F.col("open") == 0, F.col("last_if_out")).otherwise(F.col("last_if_in"))
    ends = ends.withColumn("start", F.when(last.isNotNull(), F.struct(F.col("block").alias("block"), last.alias("line"))))
    ends = ends.withColumn("carried", F.last("start", True).over(before)).select("file", "block", "open", "carried")
    marked = lines.mapInArrow(_marked_lines, MARKED).drop("quotes")
    found = attach(marked, ends, ["file", "block"])
    inside = F.pmod(F.col("inside") + F.col("open"), F.lit(2)) == 1
    # Of a line inside quotes the record starts at the last line before it that lies outside.
    found = found.withColumn("from", F.when(F.col("open") == 0, F.col("from_if_out")).otherwise(F.col("from_if_in")))
    start = F.when(~inside, F.struct(F.col("block").alias("block"), F.col("line").alias("line"))).when(
        F.col("from").isNotNull(), F.struct(F.col("block").alias("block"), F.col("from").alias("line"))
    ).otherwise(F.col("carried"))
    found = found.select("file", "block", "line", "value", inside.alias("inside"), (F.col("odd") == 1).alias("odd"), start.alias("start"))
    whole = found.filter("NOT inside AND NOT odd").select("file", "block", "line", F.col("value").alias("record"))
    # In the order of the file within a task, as readers of lines give them.
    whole = whole.sortWithinPartitions("file", "block", "line")
    parts = found.filter("inside OR odd").groupBy("file", "start").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("record")
    )
    parts = parts.select("file", "start.block", "start.line", "record")
    return whole.unionByName(parts)


MARKED = "file string, block long, line long, value string, odd int, inside int, from_if_out long, from_if_in long, quotes long"


def _marked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits with their number, whether their quotes are odd, whether those before them in the split are, the last line up to each that lies outside quotes
    if the split begins outside (or inside) them, and, on its last line so far, the split's quotes. Lines of a split come in order."""
    split, line, held, outside = None, 0, 0, [-1, -1]
    for batch in batches:
        files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        counts = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip([0, *cuts], [*cuts, len(counts)]):
            if a == b:
                continue
            here = (batch.column("file")[a].as_py(), int(blocks[a]))
            if here != split:
                split, line, held, outside = here, 0, 0, [-1, -1]
            places, total = line + np.arange(b - a), held + np.cumsum(counts[a:b])
            inside = (total - counts[a:b]) % 2
            last = [np.maximum(np.maximum.accumulate(np.where(inside == k, places, -1)), outside[k]) for k in (0, 1)]
            out.append((places, counts[a:b] % 2, inside, *last, total))
            line, held, outside = line + b - a, int(total[-1]), [int(x[-1]) for x in last]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 6
        place, odd, inside, if_out, if_in, quotes = columns
        yield pa.record_batch(
            {
                "file": batch.column("file"),
                "block": batch.column("block"),
                "line": pa.array(place, pa.int64()),
                "value": batch.column("value"),
                "odd": pa.array(odd, pa.int32()),
                "inside": pa.array(inside, pa.int32()),
                "from_if_out": pa.array(if_out, pa.int64(), mask=if_out < 0),
                "from_if_in": pa.array(if_in, pa.int64(), mask=if_in < 0),
                "quotes": pa.array(quotes, pa.int64()),
            }
        )


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    keep_bad: bool = False,
) -> DataFrame:
    """CSV with a header record, quoted line breaks included. Without ``sep`` the delimiter is sniffed; records with too many fields are
    left out (``surplus_records`` returns them), short ones are filled with nulls. With ``keep_bad`` a column ``_surplus`` holds the first field too many.

    Give ``schema`` for large inputs; otherwise everything is read as text and one aggregate over all
    columns decides the types (``infer``)."""
    rows, fields = _parsed(spark, path, sep, schema)
    good = rows if keep_bad else rows.filter("_surplus is null").drop("_surplus")
    good = good.select([f"`{c}`" for c in good.columns if c not in _PLACE])
    return typed(good) if infer and schema is None else good


_PLACE = ("_file", "_block", "_line", "_record")


def _parsed(spark: SparkSession, path: str, sep: str | None, schema: T.StructType | str | None) -> tuple[DataFrame, T.StructType]:
    sep = sep or sniff_delimiter(spark, path)
    records = csv_records(spark, path)
    head = records.filter("block = 0 AND line = 0")
    if schema is None:
        first = head.orderBy("file").select("record").first()
        names = next(csv.reader(io.StringIO(first["record"].rstrip("\r")), delimiter=sep), []) if first else []
        fields = T.StructType([T.StructField(n, T.StringType()) for n in _safe_names(names)])
    else:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # One column beyond the header catches surplus fields.
    wide = T.StructType([*fields.fields, T.StructField("_surplus", T.StringType())])
    body = records.filter("NOT (block = 0 AND line = 0)").withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")
    cells = F.from_csv("record", _ddl(wide), {"sep": sep, "quote": '"', "escape": '"'})
    placed = body.select(*[F.col(c.removeprefix("_")).alias(c) for c in _PLACE], cells.alias("_cells"))
    return placed.select(*_PLACE, *[F.col(f"_cells.`{f.name}`").alias(f.name) for f in wide.fields]), fields


def _ddl(fields: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields.fields)


def _safe_names(names: list[str]) -> list[str]:
    """Header names; an empty one becomes ``_c`` and its place, and names that occur twice get their place behind them."""
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def surplus_records(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Records with more fields than the header: where they start (``file``, ``block``, ``line``) and their text."""
    rows, _ = _parsed(spark, path, sep, None)
    return rows.filter("_surplus is not null").select(*[F.col(c).alias(c.removeprefix("_")) for c in _PLACE])


def count_bad_lines(spark: SparkSession, path: str, sep: str | None = None) -> int:
    return surplus_records(spark, path, sep).count()


def typed(df: DataFrame) -> DataFrame:
    """Text columns whose every value is an integer, a number or a boolean get that type."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    tests = {"long": INTEGER_TEXT, "double": NUMBER_TEXT, "boolean": BOOLEAN_TEXT}
    parts = [
        F.bool_and(F.col(f"`{c}`").rlike(p)).alias(f"{t}{i}") for i, c in enumerate(columns) for t, p in tests.items()
    ]
    row = df.agg(*parts).first()
    kinds = {c: next((t for t in tests if row[f"{t}{i}"]), None) for i, c in enumerate(columns)}
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).try_cast(t) for c, t in kinds.items() if t})


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with an optional ``tags:`` header between ``---`` lines: ``(chunk_id, text, tags)``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    header = F.regexp_extract("value", r"(?s)^---(.*?)---", 1)
    body = F.regexp_replace("value", r"(?s)^---.*?---\s*", "")
    return files.select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("chunk_id"),
        F.trim(body, F.lit(" \t\r\n")).alias("text"),
        F.trim(F.regexp_extract(header, r"(?m)^tags:\s*(.+)$", 1)).alias("tags"),
    )
