"""Pieces that several operators of this subpackage use: stored intermediate tables and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import stored as _stored

#: A word of every contract: a run of characters other than space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it from there; the shuffle files of the
    write are given back at once, so that a job of several steps never holds those of all steps."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return _stored(df)
    finally:
        spark.conf.set(_CLEAN_UP, before)


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least, so that numpy copies stay small."""
    texts, start, size = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def n_words(text: str = "text"):
    """Number of words of a text column, null counting as empty, by SQL functions only."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")
