"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

Every word has a sparse index vector of a few +1 and -1, drawn by its hash. A word's context vector is the sum of the index vectors of its neighbours over the
whole corpus; words share ``BUCKETS`` hashed rows, so the table has a fixed size however large the corpus is. Tasks add up integers, which are summed
again per bucket, so the table does not depend on the partitioning. A document is the mean and the spread of its words' vectors and of the
likeness of neighbouring ones, how many words it has, and how often they are new.

A network of two layers is fitted on a bounded sample of labelled documents: at most ``SAMPLE``, those with the least hash of their id, from
the folds 1 to 4 of ``crc32(doc_id) mod 5``. One in four of them is held back from the fit; on these a temperature is chosen that makes the
probabilities right, and then all documents are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import words as W
from tallyfold.llm.shared import raw_texts, slices

BUCKETS = 1 << 13
WIDTH = 32
#: Entries of an index vector, and neighbours on each side.
SPARSE = 4
REACH = 2
#: Length of a word vector; entries are whole numbers. Words read at a time.
UNIT = 1 << 12
PIECE = 200_000
SAMPLE = 20_000
FOLDS = 5
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3
FEATURES = 2 * WIDTH + 4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_GAP = np.uint64(0x9E3779B97F4A7C15)


def _spaced(text: bytes) -> bytes:
    """The text with a space wherever a run of letters meets a run of signs, so that "word," is two words."""
    raw = np.frombuffer(text, np.uint8)
    if raw.size < 2:
        return text
    letter, blank = _LETTER[raw], _BLANK[raw]
    edge = (letter[1:] != letter[:-1]) & ~blank[1:] & ~blank[:-1]
    return np.insert(raw, np.flatnonzero(edge) + 1, 32).tobytes()


def read(texts: list[bytes]) -> W.Words:
    """Words of some texts: runs of letters and digits, and runs of other signs."""
    return W.read([_spaced(t) for t in texts])


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the ``SPARSE`` entries of each word's index vector."""
    spread = W.mix(hashes[:, None] + _GAP * np.arange(1, SPARSE + 1, dtype=np.uint64))
    return (spread % np.uint64(WIDTH)).astype(np.int64), np.where(spread >> np.uint64(63), 1, -1).astype(np.int64)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (W.mix(hashes.copy()) % np.uint64(BUCKETS)).astype(np.int64)


def context_counts(found: W.Words) -> np.ndarray:
    """Sum of the neighbours' index vectors, per bucket, over some texts. Long runs of words are taken a piece at a time."""
    total = np.zeros(BUCKETS * WIDTH, np.int64)
    owner = W.owners(found.first)
    for a in range(0, found.hashes.size, PIECE):
        hashes, own = found.hashes[a : a + PIECE + REACH], owner[a : a + PIECE + REACH]
        at, (columns, signs) = _buckets(hashes), index_vectors(hashes)
        for step in range(1, REACH + 1):
            # Pairs whose left word lies in this piece; the last REACH words belong to the next.
            same = np.flatnonzero(own[step:] == own[:-step])
            same = same[same < PIECE]
            for left, right in ((same, same + step), (same + step, same)):
                cell = at[left][:, None] * WIDTH + columns[right]
                total += np.bincount(cell.ravel(), signs[right].ravel(), BUCKETS * WIDTH).astype(np.int64)
    return total.reshape(BUCKETS, WIDTH)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, WIDTH), np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            total += context_counts(read(raw_texts(part.column("text"))))
    some = np.flatnonzero(total.any(axis=1))
    yield pa.record_batch(
        {"bucket": pa.array(some, pa.int32())} | {f"v{k}": pa.array(total[some, k]) for k in range(WIDTH)}
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors: a row per bucket, of length ``UNIT``, without the direction that all words share."""
    columns = [f"v{k}" for k in range(WIDTH)]
    schema = ", ".join(["bucket int", *[f"{c} long" for c in columns]])
    sums = docs.select("text").mapInArrow(_contexts, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns])
    rows = sums.toArrow()  # at most BUCKETS rows
    table = np.zeros((BUCKETS, WIDTH))
    if rows.num_rows:
        values = np.stack([rows.column(c).to_numpy() for c in columns], axis=1).astype(float)
        table[rows.column("bucket").to_numpy()] = values
        length = np.linalg.norm(table, axis=1, keepdims=True)
        table = np.divide(table, length, out=np.zeros_like(table), where=length > 0)
        table -= table[length[:, 0] > 0].mean(axis=0) * (length > 0)
        length = np.linalg.norm(table, axis=1, keepdims=True)
        table = np.divide(table, length, out=np.zeros_like(table), where=length > 0)
    return np.rint(table * UNIT).astype(np.int16)


def pooled(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its words' vectors, and of the inner products of neighbouring ones, log of the words' number, share of
    different ones. Without words all are 0. Sums are of integers, so the features do not depend on what other texts are read along."""
    found = read(texts)
    counts, out = found.counts(), np.zeros((len(texts), FEATURES), np.float32)
    some = np.flatnonzero(counts)
    if not some.size:
        return out
    owner, sums, squares = W.owners(found.first), *np.zeros((2, len(texts), WIDTH + 1), np.int64)
    for a in range(0, owner.size, PIECE):
        # One word of the next piece along, as the last one's neighbour.
        vectors = table[_buckets(found.hashes[a : a + PIECE + 1])].astype(np.int64)
        own = owner[a : a + PIECE + 1]
        likeness = np.zeros(own.size, np.int64)
        likeness[:-1] = np.where(own[1:] == own[:-1], np.einsum("ij,ij->i", vectors[1:], vectors[:-1]) // UNIT, 0)
        values, own = np.column_stack([vectors, likeness])[:PIECE], own[:PIECE]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += np.add.reduceat(values, starts, axis=0)
        squares[own[starts]] += np.add.reduceat(values * values, starts, axis=0)
    n = counts[some][:, None]
    mean, square = sums[some] / (n * UNIT), squares[some] / (n * UNIT * UNIT)
    out[some, : WIDTH + 1] = mean
    out[some, WIDTH + 1 : 2 * WIDTH + 2] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[some, -2] = np.log1p(counts[some])
    order = np.lexsort((found.hashes, owner))
    ranked, own = found.hashes[order], owner[order]
    new = np.ones(order.size, bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1])
    out[some, -1] = np.bincount(own[new], minlength=len(texts))[some] / counts[some]
    return out


@dataclass
class Network:
    """Two layers over scaled features; ``score`` is the probability of label 1 at the chosen temperature."""

    middle: np.ndarray
    scale: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        # Plain sums: a matrix product may round a row differently in another batch.
        hidden = np.maximum(np.einsum("ij,jk->ik", (features - self.middle) / self.scale, self.first[0]) + self.first[1], 0)
        return np.einsum("ij,j->i", hidden, self.second[0]) + self.second[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        return _chance(self.logits(features.astype(float)) / self.temperature)


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def fit(features: np.ndarray, good: np.ndarray, seed: int = 7) -> Network:
    """The network by Adam on mini-batches with weight decay, then its temperature. Without rows of both labels the score is the share of label 1, 0.5 without rows."""
    features, good = features.astype(float), good.astype(float)
    width = features.shape[1]
    if not good.size or good.min() == good.max():
        share = (good.sum() + 1) / (good.size + 2)
        flat = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN))
        return Network(np.zeros(width), np.ones(width), flat, (np.zeros(HIDDEN), float(np.log(share / (1 - share)))))
    held = np.arange(good.size) % 4 == 3
    x, y = features[~held], good[~held]
    scale = x.std(axis=0)
    middle, scale = x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    state = [
        rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
        np.array(np.log(share / (1 - share))),
    ]
    speed, power, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    x = (x - middle) / scale
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        order = rng.permutation(y.size)
        for a in range(0, y.size, 256):
            own = order[a : a + 256]
            before = x[own] @ state[0] + state[1]
            hidden = np.maximum(before, 0)
            error = (_chance(hidden @ state[2] + state[3]) - y[own]) / own.size
            back = np.outer(error, state[2]) * (before > 0)
            slopes = [x[own].T @ back + 1e-4 * state[0], back.sum(axis=0), hidden.T @ error + 1e-4 * state[2], error.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                speed[k] = 0.9 * speed[k] + 0.1 * slope
                power[k] = 0.999 * power[k] + 0.001 * slope * slope
                move = speed[k] / (1 - 0.9**step) / (np.sqrt(power[k] / (1 - 0.999**step)) + 1e-8)
                state[k] = state[k] - rate * move
    net = Network(middle, scale, (state[0], state[1]), (state[2], float(state[3])))
    if held.any():
        net.temperature = _temperature(net.logits(features[held]), good[held])
    return net


def _temperature(logits: np.ndarray, good: np.ndarray) -> float:
    """The temperature with the least log loss, by a grid that is refined around its best point."""
    low, high = np.log(0.25), np.log(8.0)
    for _ in range(4):
        grid = np.linspace(low, high, 25)
        loss = [-np.mean(np.log(np.clip(_chance(np.where(good > 0, logits, -logits) / np.exp(t)), 1e-12, 1))) for t in grid]
        best = int(np.argmin(loss))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, grid.size - 1)]
    return float(np.exp(grid[best]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document lies in the fold that labels are never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``text`` and ``quality`` of the labelled documents that are learned from. Rows that repeat an id give one label, the lesser, and one text,
    the least. The ids are a bounded number, so they may be broadcast."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def _features(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                values = pooled(raw_texts(part.column("text")), table)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "quality": part.column("quality"), "features": lists})

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on the sample of labelled ones."""
    table = word_vectors(docs)
    rows = sample(docs, labels, most)
    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, features array<float>"
    rows = rows.mapInArrow(_features(table), schema).toArrow()  # at most ``most`` rows of FEATURES numbers
    # One order for the fit, whatever order the rows come in.
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")])) if rows.num_rows else rows
    features = np.array(rows.column("features").combine_chunks().flatten(), np.float32).reshape(-1, FEATURES)
    good = rows.column("quality").to_numpy()
    mixed = np.random.default_rng(3).permutation(good.size)
    return table, fit(features[mixed], good[mixed])


def _scores(table: np.ndarray, net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                score = net.score(pooled(raw_texts(part.column("text")), table))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64())})

    return run


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on): one row per row of ``docs``.

    A null text counts as empty; texts without words all have the score that the network gives to features of 0. Null ids are scored and never
    learned from, labels other than 0 and 1 are ignored, and without labels every score is 0.5. Texts of any length are read whole, about
    a megabyte at a time or one text; other columns are ignored.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    table, net = learn(docs, labels, most)
    found = docs.mapInArrow(_scores(table, net), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
