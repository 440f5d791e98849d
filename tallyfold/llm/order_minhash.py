"""Near-duplicate documents by Order MinHash.

A document is the sequence of its five-word shingles, each labelled with its occurrence number. A sketch takes the few
labelled shingles with the least hashes under one permutation and keeps them in text order, so that it stays equal
under few edits and changes when parts move. Documents that agree in a sketch are candidates; a candidate pair is a link if
its edit similarity is 0.8 or more: the words common to both in order, by an alignment inside the band that this bound
allows, over the words of the longer text. Pairs whose shingle sets have a Jaccard similarity of 0.8 and keep their
order reach that as well; two shingles a sketch and 24 sketches miss such a pair once in 10^10 times, one of 0.5 once in a thousand.

Documents of the same words form a group first, so copies cost one row. Every member of a bucket is aligned with the bucket's leader, and the links
make classes. What is left are pairs of different classes in one bucket. In a bucket of few members (``NARROW``) each meets each. In wider ones: of two linked documents of ``n`` words and fewer, 0.8 n words are common, so if each has
its words ordered from rare to frequent, they meet in one of the first ``n - 0.8 n + 1``: each document of a wide mixed bucket is filed once under these words, and
those of different classes meet there. Of either kind, those that agree in a sketch, are of fitting lengths and, by maps of
their words, can have enough of them in common are aligned. No link is lost, the words of a passage that many
share bring nobody together, and a class is never paired with itself. Two passes of alignment are the whole work, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import words as W
from tallyfold.llm.shared import empty, raw_texts, slices, stored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
TAKEN = 2
#: Members up to which all pairs of a bucket are compared by lengths and word maps; more go by their rare words, whose rows repeat a document's facts under each
#: word. Either way gives the same links.
NARROW = 256
#: Members outside the largest class of a word that one task pairs; the others of the word are repeated for each such part.
PART = 1024
#: Buckets of the table of word counts that rare and frequent are told apart by; any counts give the same links.
COUNTED = 1 << 18
#: Rarer words that a row carries, so that a pair is met at its first common word only.
CARRIED = 256
#: Bits of the map of a text's words that bounds what two texts can have in common.
BITS = 2048
#: Texts of ``x_n`` and ``y_n`` words that could reach the bound by their lengths, and by what their maps differ in.
_LENGTHS = f"least(x_n, y_n) >= ceil(greatest(x_n, y_n) * {SIMILARITY}D - 1e-9D)"
_MAPS = f"""x_n + y_n - aggregate(zip_with(x_bits, y_bits, (a, b) -> bit_count(a ^ b)), 0, (t, c) -> t + c)
    >= 2 * ceil(greatest(x_n, y_n) * {SIMILARITY}D - 1e-9D)"""


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all five-word shingles; a shorter text is one shingle of all its words."""
    return W.windows(hashes, min(SHINGLE, hashes.size)) if hashes.size else hashes


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each shingle with the number of equal ones before it."""
    ranked = np.sort(grams)
    if not (ranked[1:] == ranked[:-1]).any():
        return grams
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    nth = np.arange(grams.size) - np.repeat(starts, np.diff(np.append(starts, grams.size)))
    out = grams.copy()
    again = nth > 0
    out[order[again]] = W.pair(ranked[again], nth[again].astype(np.uint64))
    return out


def least_in_order(marked: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each permutation the ``TAKEN`` least labelled shingles, in text order; a text with fewer repeats its last."""
    taken, step = min(TAKEN, marked.size), max(1, 1_000_000 // marked.size)
    out = np.empty((seeds.size, TAKEN), np.uint64)
    for a in range(0, seeds.size, step):
        seed = seeds[a : a + step, None]
        ranks = (marked[None, :] ^ seed) * (seed | np.uint64(1))
        if taken < marked.size:
            at = np.sort(np.argpartition(ranks, taken - 1, axis=1)[:, :taken], axis=1)
        else:
            at = np.broadcast_to(np.arange(taken), (ranks.shape[0], taken))
        out[a : a + step, :taken] = marked[at]
        out[a : a + step, taken:] = marked[at[:, -1:]]
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = W.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
    for batch in batches:
        for part in slices(batch, "text"):
            found = W.read(raw_texts(part.column("text")))
            first, counts = found.first, found.counts()
            grams = W.windows(found.hashes, SHINGLE)
            place = np.arange(found.hashes.size) - np.repeat(first[:-1], counts)
            parts = np.stack([W.pair(found.hashes, place.astype(np.uint64) + np.uint64(k << 40)) for k in (0, 1)], axis=1)
            some = np.flatnonzero(counts)
            content = np.bitwise_xor.reduceat(parts, first[some], axis=0) if some.size else parts
            least = np.empty((some.size, SKETCHES, TAKEN), np.uint64)
            for k, i in enumerate(some):
                a, n = first[i], counts[i]
                own = grams[a : a + n - SHINGLE + 1] if n >= SHINGLE else shingles(found.hashes[a : a + n])
                least[k] = least_in_order(labelled(own), seeds)
            keys = np.broadcast_to(seeds, least.shape[:2])
            for j in range(TAKEN):
                keys = W.pair(keys, least[:, :, j])
            present = pa.array(counts > 0)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id").filter(present),
                    "mark": part.column("mark").filter(present),
                    "content": pa.array([x.tobytes() for x in content], pa.binary()),
                    "n": pa.array(counts[some], pa.int32()),
                    "keys": pa.FixedSizeListArray.from_arrays(keys.ravel().view(np.int64), SKETCHES).cast(pa.list_(pa.int64())),
                }
            )


def common_length(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose places differ by at most ``band``: one row of the alignment at a time,
    its columns being the bits of a number, of which only those inside the band are held."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    row, low, top, found = 0, 0, 0, 0
    for i, x in enumerate(a):
        while low < min(i - band, len(b)):
            found += not row & 1
            row >>= 1
            low += 1
        new = min(i + band + 1, len(b))
        if new > top:
            row |= ((1 << new - top) - 1) << top - low
            top = new
        if top <= low:
            continue
        mask = (1 << top - low) - 1
        hit = row & places.get(x, 0) >> low
        if hit:
            row = (row + hit | row & ~hit) & mask
    return found + (top - low) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, bound: float = SIMILARITY) -> float:
    """Words common in order over the words of the longer text, or 0 if that is below the bound. Whatever could not
    reach the bound, by length or by the words held in common, is not aligned."""
    na, nb = a.size, b.size
    need = int(np.ceil(max(na, nb) * bound - 1e-9))
    m = min(na, nb)
    if m < need:
        return 0.0
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if differ.size else m
    m -= head
    differ = np.flatnonzero(a[na - m :][::-1] != b[nb - m :][::-1])
    tail = int(differ[0]) if differ.size else m
    x, y = a[head : na - tail], b[head : nb - tail]
    common = head + tail
    if x.size and y.size:
        values, counts = np.unique(x, return_counts=True)
        others, there = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
        if common + int(np.minimum(counts[i], there[j]).sum()) < need:
            return 0.0
        common += common_length(x.tolist(), y.tolist(), max(na, nb) - need)
    return common / max(na, nb) if common >= need else 0.0


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        likeness = []
        last, left = None, None
        for x, y in zip(batch.column("left_text"), batch.column("right_text")):
            pair = [z.as_buffer().to_pybytes() for z in (x, y)]
            if pair[0] != last:
                last, left = pair[0], W.read(pair[:1]).hashes
            likeness.append(similar(left, W.read(pair[1:]).hashes))
        yield pa.record_batch(
            {"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(likeness, pa.float64())}
        )


def _links(pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) of representatives that the alignment confirms."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right_text")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left_text")), "a"
    )
    rows = both.select("a", "b", "left_text", "right_text").mapInArrow(_aligned, f"a {kind}, b {kind}, similarity double")
    return rows.filter("similarity > 0")


def spread(facts: DataFrame) -> DataFrame:
    """Facts, one row per key, dealt anew: joined by their key they then meet rows whose hot keys adaptive execution can split, which it cannot
    while the facts still lie where they were aggregated."""
    return facts.repartition(*facts.columns)


def _tokens(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with their occurrence numbers, and the bucket of each in the table of counts."""
    tokens = labelled(hashes)
    return tokens, (tokens % np.uint64(COUNTED)).astype(np.int64)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTED, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            found = W.read(raw_texts(part.column("text")))
            for a, b in zip(found.first[:-1], found.first[1:]):
                buckets, times = np.unique(_tokens(found.hashes[a:b])[1], return_counts=True)
                total[buckets] += times
    some = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})


def rare_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a text, one of which every linked text shares, from rare to frequent."""
    tokens, buckets = _tokens(hashes)
    order = np.lexsort((tokens, counts[buckets]))
    return tokens[order[: hashes.size - int(np.ceil(hashes.size * SIMILARITY - 1e-9)) + 1]]


def shared_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of the rare words that another text may hold: a word counted once brings nobody together. Places among them are no later than among all, so
    bounds by places stay bounds."""
    rare = rare_words(hashes, counts)
    return rare[counts[(rare % np.uint64(COUNTED)).astype(np.int64)] != 1]


def word_map(hashes: np.ndarray) -> np.ndarray:
    """A bit per word and occurrence number. Two maps differ in no more bits than the texts in words."""
    held = np.zeros(BITS, np.uint8)
    held[(labelled(hashes) >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(held, bitorder="little").view(np.int64)


def _filed(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = W.read(raw_texts(part.column("text")))
                words = [shared_words(found.hashes[a:b], counts).view(np.int64) for a, b in zip(found.first[:-1], found.first[1:])]
                at = np.cumsum([0, *map(len, words)])
                flat = np.concatenate(words) if words else np.empty(0, np.int64)
                maps = [word_map(found.hashes[a:b]) for a, b in zip(found.first[:-1], found.first[1:])]
                maps = np.concatenate(maps) if maps else np.empty(0, np.int64)
                yield pa.record_batch(
                    {
                        "rep": part.column("rep"),
                        "class_id": part.column("class_id"),
                        "near": part.column("near"),
                        "wide": part.column("wide"),
                        "n": pa.array(found.counts(), pa.int32()),
                        "words": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                        "bits": pa.FixedSizeListArray.from_arrays(pa.array(maps), BITS // 64).cast(pa.list_(pa.int64())),
                    }
                )

    return run


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``rep``, ``class_id`` of the members of buckets that hold several classes, and the keys of these buckets: ``near`` those of few members, ``wide`` the others."""
    named = members.select("key", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("key", "rep", F.coalesce("class_id", "rep").alias("class_id"))
    ends = named.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("m"))
    named = named.join(spread(ends.filter("low <> high").select("key", (F.col("m") <= NARROW).alias("few"))), "key")
    return named.groupBy("rep", "class_id").agg(F.collect_set(F.expr("IF(few, key, NULL)")).alias("near"), F.collect_set(F.expr("IF(few, NULL, key)")).alias("wide"))


def _held(side: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in columns]


def _in_narrow(filed: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one narrow bucket, of different classes, that lengths and maps do not rule out. A member meets fewer than ``NARROW`` others."""
    rows = filed.select(F.explode("near").alias("key"), "rep", "class_id", "n", "bits")
    x, y = (rows.select(F.col("key").alias(f"{s}_key"), *_held(s, "rep", "class_id", "n", "bits")) for s in "xy")
    met = x.join(y, F.expr(f"x_key = y_key AND x_rep < y_rep AND x_class_id <> y_class_id AND {_LENGTHS} AND {_MAPS}"))
    return met.selectExpr("x_rep AS a", "y_rep AS b")


def _in_wide(filed: DataFrame) -> DataFrame:
    """The same for wide buckets. Under each word members outside the largest class meet all of other classes; a pair is met at the rarest word that both are
    filed under."""
    filed = filed.filter("size(wide) > 0").withColumnRenamed("wide", "keys")
    flat = filed.select("rep", "class_id", F.posexplode("words").alias("place", "word"))
    pieces = flat.groupBy("word", "class_id").agg(F.count("*").alias("m"))
    main = F.max_by("class_id", F.struct("m", "class_id")).alias("main")
    pieces = pieces.groupBy("word").agg(main, F.sum("m").alias("m"), F.count("*").alias("classes")).filter("classes > 1")
    pieces = pieces.select("word", "main", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    # Words of one class bring nobody together; a row carries the rarer ones of the others.
    kept = flat.join(spread(pieces), "word").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "word", "main", "parts"))).alias("kept"))
    rows = kept.join(filed.drop("words", "near"), "rep").select("rep", "class_id", "keys", "n", "bits", "kept", F.posexplode("kept").alias("nth", "own"))
    before = F.slice("kept.word", 1, F.least("nth", F.lit(CARRIED)))
    rows = stored(rows.select("own.word", "own.main", "own.parts", "own.place", "rep", "class_id", "keys", "n", "bits", before.alias("before")))
    held = ("rep", "class_id", "keys", "n", "place", "bits", "before")
    some = rows.filter("class_id <> main").select(F.col("word").alias("x_word"), F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("x_part"), *_held("x", *held))
    others = rows.select("word", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "main", *_held("y", *held))
    fits = f"""x_class_id <> y_class_id AND (y_class_id = main OR x_class_id < y_class_id) AND {_LENGTHS}
        AND least(x_n - x_place, y_n - y_place) >= ceil(greatest(x_n, y_n) * {SIMILARITY}D - 1e-9D)
        AND arrays_overlap(x_keys, y_keys) AND NOT arrays_overlap(x_before, y_before) AND {_MAPS}"""
    met = some.join(others, F.expr(f"x_word = word AND x_part = part AND {fits}"))
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))


def _across(members: DataFrame, classes: DataFrame, tried: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) of documents in one mixed bucket that lie in different classes, may be linked, and were not aligned before."""
    own = stored(texts.join(_mixed(members, classes), F.col("doc_id") == F.col("rep")).select("rep", "class_id", "near", "wide", "text"))
    # A row per bucket of the table, a fixed number.
    wide = own.filter("size(wide) > 0")
    seen = wide.select("text").mapInArrow(_token_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTED, np.int64)
    counts[seen.column("bucket").to_numpy()] = seen.column("n").to_numpy()
    filed = stored(own.mapInArrow(_filed(counts), f"rep {kind}, class_id {kind}, near array<long>, wide array<long>, n int, words array<long>, bits array<long>"))
    pairs = _in_narrow(filed).unionByName(_in_wide(filed)).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``class_id``: the least node that links lead to. Each round, one stored table, ties every node's larger neighbours, then its
    smaller ones, to the least of them, until all that is left are stars: no node is tied to two, none that others are tied to is tied itself."""
    edges = stored(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct())
    while True:
        ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").unionByName(edges.selectExpr("v AS node", "0 AS up", "1 AS down"))
        if empty(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1")):
            break
        around = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(spread(least), "u").selectExpr("v AS u", "m AS v")
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", least).select(F.expr("IF(v = m, u, v)").alias("u"), F.col("m").alias("v"))
        edges = stored(small.distinct())
    return edges.selectExpr("u AS node", "v AS class_id").unionByName(edges.selectExpr("v AS node", "v AS class_id")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (least ``doc_id`` of its class), ``n_links``: one row per document.

    ``n_links`` counts aligned partners with different words, of the group of same-word documents that this one
    belongs to; pairs known to lie in one class are not aligned again. Documents without words, with null text or null ``doc_id``
    form no group: each is a class of its own. Rows that repeat a ``doc_id`` give one row; of their different texts the one with the least hash of
    its words counts, in whatever order the rows come. An empty table has no rows; texts of any length are read whole; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    whole = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    found = whole.mapInArrow(_sketches, f"doc_id {kind}, mark long, content binary, n int, keys array<long>")
    found = stored(found.groupBy("doc_id").agg(F.min(F.struct("content", "mark", "n", "keys")).alias("x")).select("doc_id", "x.*"))
    groups = found.groupBy("content").agg(F.min(F.struct("doc_id", "mark", "n", "keys")).alias("x"))
    groups = stored(groups.select("content", F.col("x.doc_id").alias("rep"), "x.mark", "x.n", "x.keys"))
    members = groups.select("rep", F.col("n").alias("y_n"), F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.min(F.struct("rep", "y_n")).alias("x"), F.count("*").alias("m")).filter("m > 1")
    leaders = leaders.select("key", F.col("x.rep").alias("leader"), F.col("x.y_n").alias("x_n"))
    members = stored(members.join(spread(leaders), "key").select("key", "rep", "leader", "x_n", "y_n"))
    pairs = stored(members.filter(f"rep <> leader AND {_LENGTHS}").selectExpr("leader AS a", "rep AS b").distinct())
    needed = members.select("rep").distinct()
    needed = groups.select("rep", "mark").join(needed, "rep").withColumnRenamed("rep", "doc_id")
    # Ids in candidate pairs grow with the corpus: sorted and merged at every size, never broadcast.
    texts = stored(whole.join(needed.hint("merge"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).drop("mark"))
    links = stored(_links(pairs, texts, kind))
    classes = components(links)
    more = stored(_links(_across(members, classes, pairs, texts, kind), texts, kind))
    if not empty(more):
        links = links.unionByName(more)
        classes = components(classes.selectExpr("class_id AS a", "node AS b").unionByName(more.select("a", "b")))
    counts = links.selectExpr("a AS rep").unionByName(links.selectExpr("b AS rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = (
        groups.select("content", "rep")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .select("content", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    named = found.select("doc_id", "content").join(spread(named), "content").drop("content")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(named, "doc_id", "left")
    lone = docs.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast(kind).alias("class_id"), F.lit(None).cast("long").alias("n_links"))
    return ids.unionByName(lone).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
