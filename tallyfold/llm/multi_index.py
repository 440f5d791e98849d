"""Approximate nearest neighbours by an inverted multi-index.

Vectors are sorted into bands by their length, each band reaching down to half of its longest. In units of that length every vector gets one coordinate more, which makes
all norms one, and a query a zero there, so that near vectors are those of a large inner product. The two halves are quantised by codebooks
of their own, so a pair of centroids is a cell of its band. A query goes through the cells by the sum of its halves' distances to the two centroids, times the band's length,
from a heap, until a share of the index has been met, and these are ranked again by the exact inner product of the original vectors.

Codebooks are fitted on a bounded sample; every vector is indexed. The index is packed into blocks of one first centroid and a
few thousand vectors; queries are packed too and meet the blocks of the first centroids they visit by a join. Of equal vectors only the
smallest ids a query can return are kept, so a vector that fills a third of the table is a few rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.shared import stored

#: Vectors that the codebooks are fitted on, those with the least hash of their id.
SAMPLE = 20_000
CENTROIDS = 32
#: Bands of lengths; the last one holds all that are shorter.
BANDS = 16
#: Share of the index that a query meets, k rows at least. Directions without any structure need this much for a recall of 0.9; clustered ones far less.
SHARE = 0.55
BLOCK = 8_192
PACK = 256


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``vector``: rows with an id and a vector of finite numbers, not all zero, of the most common length."""
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    found = rows.select("vec_id", "embedding").filter(sound)
    lengths = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0].n if lengths else 0
    return found.filter(F.size("embedding") == length).select("vec_id", F.col("embedding").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly taken points; a centroid that loses all its points stays."""
    centres = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def bands(vectors: np.ndarray, longest: float) -> np.ndarray:
    length = np.sqrt((vectors**2).sum(1))
    return np.clip(np.floor(np.log2(longest / length)), 0, BANDS - 1).astype(np.int32)


def halves(vectors: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Both halves in units of the band's length, the second with the coordinate that makes up for the vector's own length."""
    vectors, half = vectors / (longest * 0.5 ** bands(vectors, longest))[:, None], vectors.shape[1] // 2
    rest = np.sqrt(np.maximum(1 - (vectors**2).sum(1), 0))
    return vectors[:, :half], np.column_stack([vectors[:, half:], rest])


def asked(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of queries of length one, which need no length made up."""
    queries, half = queries / np.sqrt((queries**2).sum(1))[:, None], queries.shape[1] // 2
    return queries[:, :half], np.column_stack([queries[:, half:], np.zeros(len(queries))])


def fit(vectors: DataFrame, longest: float, sample: int = SAMPLE, size: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray] | None:
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    if not some:
        return None
    points = np.array([r.vector for r in some], np.float64)
    return tuple(_codebook(h, size) for h in halves(points, longest))


def _distances(parts: tuple[np.ndarray, np.ndarray], books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple((b**2).sum(1) - 2 * v @ b.T for v, b in zip(parts, books))


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """The cells (band, first, second) that a query meets until they hold ``wanted`` vectors. A vector of unit length at squared distance ``d`` has an inner product of
    ``1 - d / 2`` with the query, in units of its band, so bands go by their share of that."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y, sizes = first.tolist(), second.tolist(), counts.tolist()
    met = np.zeros(counts.shape, bool)
    key = lambda n, i, j: 0.5**n * (x[a[i]] + y[b[j]] - 1)
    heap = [(key(n, 0, 0), n, 0, 0) for n in np.flatnonzero(counts.any(axis=(1, 2))).tolist()]
    heapq.heapify(heap)
    got, reach = 0, [[0] * len(a) for _ in sizes]
    while heap and got < wanted:
        _, n, i, j = heapq.heappop(heap)
        met[n, a[i], b[j]] = True
        got += sizes[n][a[i]][b[j]]
        reach[n][i] = j + 1
        if j + 1 < len(b) and (i == 0 or reach[n][i - 1] > j + 1):
            heapq.heappush(heap, (key(n, i, j + 1), n, i, j + 1))
        if i + 1 < len(a) and reach[n][i + 1] == j:
            heapq.heappush(heap, (key(n, i + 1, j), n, i + 1, j))
    return met


def search(rows: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: of each query the ``k`` nearest found by largest inner product, ties to the
    smaller id; all candidates if there are fewer. A query never finds rows of its own id.

    Null ids and vectors that are null, zero, hold null or non-finite numbers or have another length than most take no part.
    Rows that repeat id and vector count once. Other columns are ignored."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["vec_id"]
    vectors = stored(usable(rows))
    square = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    longest = vectors.agg(F.sqrt(F.max(square))).first()[0]
    books = fit(vectors, longest)
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if books is None:
        return spark.createDataFrame([], result)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = vectors.distinct().withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vector")).astype(np.float64)
            cells = [np.argmin(d, axis=1).astype(np.int32) for d in _distances(halves(v, longest), books)] if len(v) else [np.empty(0, np.int32)] * 2
            first = bands(v, longest) * len(books[0]) + cells[0] if len(v) else cells[0]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "first": first.astype(np.int32), "second": cells[1], "vector": batch.column("vector")})

    floats = dict(vectors.dtypes)["vector"]
    index = stored(distinct.mapInArrow(assign, f"vec_id {kind}, first int, second int, vector {floats}"))
    counts = np.zeros((BANDS * len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("first", "second").count().collect():  # one row per cell, a fixed number at most
        counts[r["first"], r["second"]] = r["count"]
    # A query can skip its own rows and still find k.
    own = vectors.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    wanted = max(k + own, int(np.ceil(share * counts.sum())))

    in_bands = counts.reshape(BANDS, len(books[0]), len(books[1]))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PACK):
                part = batch.slice(a, PACK)
                v = _matrix(part.column("vector")).astype(np.float64)
                met = np.stack([visited(x, y, in_bands, wanted).reshape(counts.shape) for x, y in zip(*_distances(asked(v), books))])
                cells = [c for c in range(counts.shape[0]) if met[:, c].any()]
                ids = pa.array([part.column("vec_id").to_pylist()] * len(cells), pa.list_(part.column("vec_id").type))
                yield pa.record_batch(
                    {
                        "first": pa.array(cells, pa.int32()),
                        "query_ids": ids,
                        "query_vectors": pa.array([v.tobytes()] * len(cells), pa.binary()),
                        "met": pa.array([np.packbits(met[:, c], axis=1).tobytes() for c in cells], pa.binary()),
                    }
                )

    def pack_block(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        v = _matrix(block.column("vector").combine_chunks()).astype(np.float64)
        return pa.table(
            {
                "first": pa.array([block.column("first")[0].as_py()], pa.int32()),
                "ids": pa.array([block.column("vec_id").to_pylist()], pa.list_(block.schema.field("vec_id").type)),
                "seconds": pa.array([block.column("second").combine_chunks().to_numpy().tobytes()], pa.binary()),
                "vectors": pa.array([v.tobytes()], pa.binary()),
            }
        )

    width = books[0].shape[1] + books[1].shape[1] - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["query_vectors"]).reshape(-1, width)
                v = np.frombuffer(r["vectors"]).reshape(-1, width)
                seconds = np.frombuffer(r["seconds"], np.int32)
                met = np.unpackbits(np.frombuffer(r["met"], np.uint8).reshape(len(q), -1), axis=1)[:, : counts.shape[1]].astype(bool)
                rough = np.where(met[:, seconds], q @ v.T, -np.inf)
                least = np.partition(rough, len(v) - k - 1, axis=1)[:, len(v) - k - 1] if len(v) > k else np.full(len(q), -np.inf)
                # Rounding of a product of matrices is far below this share of the vectors' lengths.
                slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((v**2).sum(1).max())
                i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
                # The same order of additions for every pair, so that equal vectors have equal scores.
                exact = np.add.reduce(q[i] * v[j], axis=1)
                query, found = np.array(r["query_ids"])[i], np.array(r["ids"])[j]
                other = query != found
                yield pa.record_batch({"query_id": query[other], "vec_id": found[other], "score": exact[other]})

    packed = vectors.filter(queries).distinct().mapInArrow(
        pack_queries, f"first int, query_ids array<{kind}>, query_vectors binary, met binary"
    )
    per_first = F.element_at(F.array(*[F.lit(int(max(1, -(-n // BLOCK)))) for n in counts.sum(1)]), F.col("first") + 1)
    blocks = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_first)).groupBy("first", "block").applyInArrow(
        pack_block, f"first int, ids array<{kind}>, seconds binary, vectors binary"
    )
    found = blocks.join(packed, "first").mapInArrow(score, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A repeated query row would find everything twice.
    ranked = found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
