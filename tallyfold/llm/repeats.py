"""Substring dedup: word windows that also start in an earlier document, found level by level.

The first level looks at windows of half the wanted length. Of those inside one wanted window only the one with the
least hash stands for it (the same in every copy), so about a quarter of all positions travel. Windows repeated there
alone are extended to twice that length, and so on to the wanted length, where each surviving window is decided by 128 bits of its
own words; ``deepest`` goes on doubling beyond it until no candidate survives.

A level is one aggregate (a window's first and last document) and one join back, both by hash, so a window that very
many documents share is one row per task before the shuffle, and adaptive execution splits its join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import words as W
from tallyfold.llm.shared import empty, raw_texts, slices, stored

LENGTH = 13


def _levels(length: int) -> list[int]:
    """Window lengths from the seed on: each at most twice the one before, the last is ``length``."""
    return [length] if length < 4 else [(length + 1) // 2, length]


def _inside(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows over all words of a slice those inside one text: places and text numbers."""
    owner = W.owners(first)
    at = np.flatnonzero(owner[: values.size] == owner[size - 1 : size - 1 + values.size])
    return at, owner[at]


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = W.read(raw_texts(part.column("text")))
                low = W.least(W.windows(found.hashes, seed), length - seed + 1)
                at, owner = _inside(low, found.first, length)
                low = low[at]
                new = np.ones(low.size, bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                yield pa.record_batch(
                    {"window": low[new].view(np.int64), "doc_id": part.column("doc_id").take(pa.array(owner[new]))}
                )

    return run


def _extended(length: int, seed: int):
    """Windows of the wanted length whose standing-in window is among the document's repeated ones, by two hashes, as these windows are decided
    by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = raw_texts(part.column("text"))
                found = W.read(texts)
                low = W.least(W.windows(found.hashes, seed), length - seed + 1)
                whole, other = W.windows(found.hashes, length), W.windows(W.read(texts, 1).hashes, length)
                kept, checks, owner = [], [], []
                for i, repeated in enumerate(_lists(part.column("windows"))):
                    a, b = found.first[i], found.first[i + 1] - length + 1
                    if b > a and repeated.size:
                        hit = np.isin(low[a:b], repeated)
                        own, at = np.unique(whole[a:b][hit], return_index=True)
                        kept.append(own)
                        checks.append(other[a:b][hit][at])
                        owner.append(np.full(own.size, i))
                kept, checks = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (kept, checks))
                owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
                yield pa.record_batch(
                    {
                        "window": kept.view(np.int64),
                        "doc_id": part.column("doc_id").take(pa.array(owner)),
                        "check": checks.view(np.int64),
                    }
                )

    return run


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False).view(np.uint64) if x.is_valid else np.empty(0, np.uint64)


def _shared(found: DataFrame, key: tuple[str, ...] = ("window",)) -> DataFrame:
    """Windows of two documents or more, each with the first of them."""
    ends = found.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.filter("first < last").select(*key, "first")


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``windows``: hashes of the document's windows that also start in a smaller ``doc_id``."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = docs.select(F.lit(0).cast("long").alias("window"), "doc_id").schema
    seed = _levels(length)[0]
    seeds, key = docs.mapInArrow(_seeds(length, seed), schema), ("window",)
    if seed < length:
        schema.add("check", "long")
        key = ("window", "check")
        common = stored(_shared(seeds))
        candidates = stored(_by_document(seeds.join(common, "window").select("doc_id", "window")))
        seeds = stored(docs.join(candidates, "doc_id").mapInArrow(_extended(length, seed), schema))
    common = stored(_shared(seeds, key))
    return stored(_by_document(seeds.join(common, list(key)).filter("doc_id > first").select("doc_id", "window")))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = raw_texts(part.column("text"))
                found = W.read(texts)
                whole = W.windows(found.hashes, length)
                rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "spans": []}
                for i, repeated in enumerate(_lists(part.column("windows"))):
                    words = texts[i].split()
                    a, b = found.first[i], found.first[i + 1] - length + 1
                    spans = []
                    if repeated.size and b > a:
                        hit = np.isin(whole[a:b], repeated)
                        change = np.zeros(len(words) + 1, np.int32)
                        change[:-length][hit] += 1
                        change[length:][hit] -= 1
                        gone = np.cumsum(change[:-1]) > 0
                        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                        spans = edges.reshape(-1, 2).tolist()
                        kept = list(compress(words, ~gone))
                    else:
                        kept = words
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(len(words) - len(kept))
                    rows["kept_text"].append(b" ".join(kept))
                    rows["spans"].append([{"start": x, "end": y} for x, y in spans])
                yield _row_batch(part, rows)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _row_batch(part: pa.RecordBatch, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": part.column("doc_id"),
            "n_words": pa.array(rows["n_words"], pa.int64()),
            "n_removed": pa.array(rows["n_removed"], pa.int64()),
            "kept_text": pa.array(rows["kept_text"], pa.binary()).cast(pa.string()),
            "spans": pa.array(rows["spans"], _SPANS),
        }
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document without the words covered by a window of ``length`` words that also starts in a smaller
    ``doc_id``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between) and ``spans``
    (word ranges removed).

    Windows are judged on the input. A null text has no words. A row with null ``doc_id`` comes before and after
    nothing: it stays whole and removes nothing. Rows that repeat a ``doc_id`` are parts of one document. Other columns are ignored.
    """
    removed = repeated_windows(docs, length)
    kind = dict(docs.dtypes)["doc_id"]
    return (
        docs.select("doc_id", "text")
        .join(removed, "doc_id", "left")
        .mapInArrow(
            _cut(length),
            f"doc_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>",
        )
    )


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors (place, hash) of a document, of one length, to windows of twice that length."""
    for batch in batches:
        for i in range(batch.num_rows):
            half = batch.column("half")[i].as_py()
            at = batch.column("places")[i].values.to_numpy(zero_copy_only=False)
            value = batch.column("hashes")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(at)
            at, value = at[order], value[order]
            other = np.minimum(np.searchsorted(at, at + half), at.size - 1)
            both = at[other] == at + half
            joined = W.pair(value[both], value[other[both]])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(np.full(joined.size, i))),
                    "place": pa.array(at[both], pa.int64()),
                    "window": joined.view(np.int64),
                }
            )


def _placed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = W.read(raw_texts(part.column("text")))
                whole = W.windows(found.hashes, length)
                at, owner = _inside(whole, found.first, length)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(owner)),
                        "place": pa.array(at - found.first[owner], pa.int64()),
                        "window": whole[at].view(np.int64),
                    }
                )

    return run


def deepest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``longest``: the greatest of ``length``, twice that, four times that … of which the document has a
    window that another document has as well. A window of twice a length is known by its two halves, so only places
    surviving at both ends are extended, and texts are read once."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    kind = dict(docs.dtypes)["doc_id"]
    rows = f"doc_id {kind}, place long, window long"
    found = docs.mapInArrow(_placed(length), rows)
    result = None
    while True:
        alive = stored(found.join(_shared(found), "window").select("doc_id", "place", "window"))
        if empty(alive):
            break
        level = alive.select("doc_id").distinct().withColumn("longest", F.lit(length).cast("long"))
        result = level if result is None else result.unionByName(level)
        packed = alive.groupBy("doc_id").agg(
            F.collect_list(F.struct("place", "window")).alias("alive"), F.lit(length).alias("half")
        ).select("doc_id", "half", F.col("alive.place").alias("places"), F.col("alive.window").alias("hashes"))
        found = packed.mapInArrow(_runs, rows)
        length *= 2
    if result is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("longest")).limit(0)
    return result.groupBy("doc_id").agg(F.max("longest").alias("longest"))
