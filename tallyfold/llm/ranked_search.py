"""Ranked lexical search: for each item of a query set the documents that score highest on the item's terms.

A document's terms that occur in the query set are stored once, as numbers with their counts. The corpus statistics (documents, terms, document
frequencies, and for each term the largest share of a score that any document gives it) are aggregates over all of them. Then each task takes a batch of documents and,
item by item, sets a bit per matched term in every document's presence mask and groups the documents by mask. No document of a mask can score more than the sum of
its terms' largest shares. Masks are evaluated from the largest such bound downwards, until the next bound is below the last score that still counts;
what is left cannot enter the result. A task hands on its best documents per item, and two window steps merge these.

The query set is taken in blocks of bounded size, each against all documents, so what tasks are given does not grow with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.shared import raw_texts, slices, stored

TOP = 20
#: Terms of all items of a block, repeats counted; an item with more is a block of its own.
PAIRS = 200_000
#: Tasks whose results one group of the first merge takes.
MERGED = 256
#: Score formula: an occurrence count's share is SCALE * tf div (1000 * tf + 12 * m).
SCALE, SLOPE, LENGTH = 1_000_000_000, 1000, 12

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TERMS = bytes(
    c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)  # separators become spaces, A-Z lower case


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TERMS).split()


@dataclass
class Item:
    """Distinct terms of an item by number, and the weight of each times its repeats."""

    numbers: np.ndarray
    repeats: np.ndarray
    gains: np.ndarray | None = None
    caps: np.ndarray | None = None


def _blocks(items: DataFrame, pairs: int) -> Iterator[list[tuple]]:
    """The items, a bounded number of terms at a time; of rows that repeat an id the least text."""
    ordered = items.groupBy("item_id").agg(F.min(F.col("text").cast("binary")).alias("text"))
    block, held = [], 0
    for row in ordered.toLocalIterator():
        found = Counter(terms(bytes(row.text or b"")))
        if block and held + len(found) > pairs:
            yield block
            block, held = [], 0
        if found:
            block.append((row.item_id, found))
            held += len(found)
    if block:
        yield block


def _postings(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, at, numbers, counts = [], [0], [], []
                for text in raw_texts(part.column("text")):
                    own = terms(text)
                    sizes.append(len(own))
                    for term, count in Counter(own).items():
                        number = vocabulary.get(term)
                        if number is not None:
                            numbers.append(number)
                            counts.append(count)
                    at.append(len(numbers))
                at = pa.array(at, pa.int32())
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": pa.array(sizes, pa.int64()),
                        "terms": pa.ListArray.from_arrays(at, pa.array(numbers, pa.int32())),
                        "counts": pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
                    }
                )

    return run


class Batch:
    """Postings of a batch of documents: for each term its documents, ascending, and their shares of a score."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("terms")
        numbers = lists.flatten().to_numpy(zero_copy_only=False)
        counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        m = batch.column("m").to_numpy(zero_copy_only=False)[rows]
        order = np.argsort(numbers, kind="stable")
        self.size, self.rows = batch.num_rows, rows[order]
        self.shares = (SCALE * counts // (SLOPE * counts + LENGTH * m))[order]
        found, starts = np.unique(numbers[order], return_index=True)
        ends = np.append(starts[1:], numbers.size)
        self.at = {int(t): (int(a), int(b)) for t, a, b in zip(found, starts, ends)}

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(int(number), (0, 0))
        return self.rows[a:b], self.shares[a:b]


def best_of(batch: Batch, item: Item, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch and their scores, every row included that is among the ``top`` best and scores ``least`` or more."""
    masks = np.zeros((batch.size, -(-item.numbers.size // 64)), np.uint64)
    bit = lambda p: np.uint64(1) << np.uint64(p % 64)
    for p, number in enumerate(item.numbers):
        masks[batch.of(number)[0], p // 64] |= bit(p)
    some = np.flatnonzero(masks.any(axis=1))
    if not some.size:
        return some, some
    if masks.shape[1] == 1:
        groups, member = np.unique(masks[some, 0], return_inverse=True)
        groups = groups[:, None]
    else:
        groups, member = np.unique(masks[some], axis=0, return_inverse=True)
        member = member.ravel()
    bounds = np.zeros(groups.shape[0], np.int64)
    for p, cap in enumerate(item.caps):
        bounds[(groups[:, p // 64] & bit(p)) != 0] += cap
    by_group = some[np.argsort(member, kind="stable")]
    sizes = np.bincount(member, minlength=groups.shape[0])
    starts = np.cumsum(sizes) - sizes
    ranking = np.argsort(-bounds, kind="stable")
    rows, scores, done, step = [], [], 0, 4 * top
    while done < ranking.size and bounds[ranking[done]] >= least:
        taken = done + 1 + int(np.searchsorted(np.cumsum(sizes[ranking[done:]]), step))
        group = ranking[done:taken]
        own = np.sort(np.concatenate([by_group[starts[g] : starts[g] + sizes[g]] for g in group]))
        total = np.zeros(own.size, np.int64)
        held = np.bitwise_or.reduce(groups[group], axis=0)
        for p, number in enumerate(item.numbers):
            if held[p // 64] & bit(p):
                there, share = batch.of(number)
                at = np.minimum(np.searchsorted(there, own), there.size - 1)
                total += np.where(there[at] == own, item.gains[p] * share[at], 0)
        rows.append(own)
        scores.append(total)
        done, step = taken, 2 * step
        every = np.concatenate(scores)
        if every.size >= top:
            least = max(least, int(np.partition(every, every.size - top)[every.size - top]))
    if not rows:
        return some[:0], some[:0]
    rows, scores = np.concatenate(rows), np.concatenate(scores)
    good = scores >= least
    return rows[good], scores[good]


def _search(items: list[Item], top: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            ids, ready = batch.column("doc_id").to_pylist(), Batch(batch)
            for k, item in enumerate(items):
                least = -best[k][-1][0] if len(best[k]) == top else 1
                rows, scores = best_of(ready, item, least, top)
                new = [(-s, ids[r] is not None, ids[r]) for r, s in zip(rows.tolist(), scores.tolist())]
                if new:
                    best[k] = sorted(best[k] + new, key=lambda x: x[:2] if x[2] is None else x)[:top]
        found = [(k, i, -s) for k, own in enumerate(best) for s, _, i in own]
        yield pa.record_batch(
            {
                "item": pa.array([x[0] for x in found], pa.int32()),
                "doc_id": pa.array([x[1] for x in found], id_type),
                "score": pa.array([x[2] for x in found], pa.int64()),
            }
        )

    return run


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, merged from groups of tasks first, so that no window holds the results of all tasks."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    for keys in (["item", "part"], ["item"]):
        window = Window.partitionBy(*keys).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    return found.drop("part")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's ``top`` documents with a score above 0, equal scores by ascending
    ``doc_id``, null first.

    Each row of ``docs`` is a document, also if it repeats an id. Null and empty texts, and texts without terms, count nowhere. Items
    that repeat an id are one item with the least text; a null ``item_id`` is an id; an item without terms has no rows. Whole texts of any length
    are read; other columns are ignored.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    kinds = {"doc_id": dict(docs.dtypes)["doc_id"], "item_id": dict(items.dtypes)["item_id"]}
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    out = []
    for block in _blocks(items, pairs):
        vocabulary: dict[bytes, int] = {}
        for _, found in block:
            for term in found:
                vocabulary.setdefault(term, len(vocabulary))
        schema = f"doc_id {kinds['doc_id']}, n long, terms array<int>, counts array<long>"
        base = stored(docs.filter("text IS NOT NULL").mapInArrow(_postings(vocabulary), schema))
        size = base.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            continue
        length = f"75 + (CAST(25 * n AS DECIMAL(20, 0)) * {size.docs}L) div {size.terms}L"
        base = base.filter("size(terms) > 0").withColumn("m", F.expr(length))
        each = base.select("m", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("m", "x.terms", F.col("x.counts").alias("tf"))
        share = F.expr(f"({SCALE}L * tf) div ({SLOPE}L * tf + {LENGTH}L * m)")
        # One row per term of the block: bounded by ``pairs``.
        known = {r.terms: r for r in each.groupBy("terms").agg(F.count("*").alias("df"), F.max(share).alias("most")).collect()}
        ready = []
        for _, found in block:
            own = [(vocabulary[t], n) for t, n in found.items() if vocabulary[t] in known]
            numbers, repeats = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)
            weight = [math.floor(1000 * math.log((2 * size.docs + 2) / (2 * known[t].df + 1))) for t, _ in own]
            gains = repeats * np.array(weight, np.int64)
            ready.append(Item(numbers, repeats, gains, gains * np.array([known[t].most for t, _ in own], np.int64)))
        found = base.select("doc_id", "m", "terms", "counts").mapInArrow(
            _search(ready, top, id_type), f"item int, doc_id {kinds['doc_id']}, score long"
        )
        part = F.floor(F.spark_partition_id() / MERGED).cast("int")
        best = _merged(found.withColumn("part", part), top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {kinds['item_id']}")
        # One row per item of the block, each with a term at least: bounded by ``pairs`` too.
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    return result


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH words AS (
        SELECT place, doc_id, unnest({_SPLIT}) AS term FROM (SELECT *, row_number() OVER () AS place FROM documents)
    ), tf AS (SELECT place, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY place, term),
    sizes AS (SELECT place, count(*) AS n FROM words GROUP BY place),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    lengths AS (SELECT place, 75 + (25 * n * docs) // terms AS m FROM sizes, whole),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
    asked AS (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark),
    scores AS (
        SELECT item_id, place, any_value(doc_id) AS doc_id,
            sum(w * (({SCALE} * tf) // ({SLOPE} * tf + {LENGTH} * m)))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (place) GROUP BY item_id, place
    )
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""
