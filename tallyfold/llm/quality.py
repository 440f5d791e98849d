"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio between trusted and raw documents.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets are estimated: of the
trusted documents and of all documents. A document's score is the mean log ratio of its n-grams, so that its length does not matter, and a
document is kept if the score reaches a fixed threshold. DataFrame operations only: one aggregate over all texts, then one projection.

The trusted multinomial is fitted on at most ``TRUSTED`` labelled documents, those with the least hash of their id; everything else covers
all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
TRUSTED = 20_000
PRIOR = 20
THRESHOLD = -0.065
_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_PLACES = 24


def words(text: str = "text") -> Column:
    """All words of a text; a null text has none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def _hashes(parts: Column) -> Column:
    return F.transform(parts, lambda w: F.coalesce(F.xxhash64(w), F.lit(0)))


def _pairs(hashes: str) -> Column:
    h = F.col(hashes)
    places = F.when(F.size(h) > 1, F.sequence(F.lit(0), F.size(h) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(h[i], h[i + 1]))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of the trusted documents that are read: a bounded number, so they may be broadcast."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _marked(docs: DataFrame, labels: DataFrame, most: int, *columns: Column | str) -> DataFrame:
    trusted = trusted_ids(labels, most).select(F.col("doc_id").alias("_trusted"))
    on = F.col("doc_id") == F.col("_trusted")
    return docs.join(F.broadcast(trusted), on, "left").select(*columns, F.col("_trusted").isNotNull().alias("trusted"))


def ratios(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> tuple[list[float], list[float]]:
    """For each bucket the log of its share in trusted documents over its share in all, as seen by an n-gram of an untrusted and of
    a trusted document: the n-gram itself is left out of the counts. ``PRIOR`` n-grams with a ratio of one are added, so a
    bucket rarely met says little."""
    hashed = _marked(docs.select("doc_id", "text"), labels, most, _hashes(words()).alias("h"))
    grams = hashed.select("trusted", F.explode(F.concat("h", _pairs("h"))).alias("gram"))
    counts = grams.groupBy(F.pmod("gram", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.count("*").alias("raw"), F.count_if("trusted").alias("good")
    )
    found = [(row.bucket, row.raw, row.good) for row in counts.collect()]  # one row per bucket, a fixed number
    trusted = sum(g for _, _, g in found)
    scale = sum(r for _, r, _ in found) / trusted if trusted else 0.0
    tables = ([0.0] * BUCKETS, [0.0] * BUCKETS)
    for bucket, raw, good in found if trusted else []:
        for own, table in enumerate(tables):
            table[bucket] = math.log((max(good - own, 0) * scale + PRIOR) / (raw - 1 + PRIOR))
    return tables


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRUSTED) -> DataFrame:
    """The documents with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``score``, ``base_failed``,
    ``kept``, in a struct column ``quality`` beside their own columns, which may have any names.

    Null text: no words, so the base rule fails. Without trusted documents every score is 0. Rows count each by
    itself; a null ``doc_id`` is never trusted."""
    # One row that the plan reads: the driver keeps a description of every plan, and literals would be spelled out in each.
    tables = docs.sparkSession.createDataFrame([ratios(docs, labels, most)], "untrusted array<double>, trusted array<double>")
    untrusted, trusted = [tables.select(x).scalar() for x in ("untrusted", "trusted")]
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    step = _marked(docs.select(row, "doc_id", "text"), labels, most, "_row", words().alias("words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.select("_row", "trusted", _hashes(F.col("words")).alias("h"), lines.alias("lines"))
    h, n = F.col("h"), F.size("h")
    # Three-word windows as one sortable number each: the upper bits of their hash, then their place.
    places = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    upper = F.lit(-(1 << _PLACES)).cast("long")
    marks = F.transform(places, lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]).bitwiseAND(upper).bitwiseOR(i.cast("long")))
    step = step.select("_row", "trusted", "h", "lines", F.sort_array(marks).alias("marks"), _pairs("h").alias("pairs"))
    s, place = F.col("marks"), lambda x: x.bitwiseAND(F.lit((1 << _PLACES) - 1)).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        return (x.bitwiseAND(upper) == y.bitwiseAND(upper)) & (h[a] == h[b]) & (h[a + 1] == h[b + 1]) & (h[a + 2] == h[b + 2])

    def doubled(s: Column, equal: Callable[[Column, Column], Column]) -> Column:
        after = lambda x, i: F.when(i < F.size(s) - 1, equal(x, s[i + 1])).otherwise(False)
        return F.filter(s, lambda x, i: F.when(i > 0, equal(x, s[i - 1])).otherwise(False) | after(x, i))

    # A text of so many windows that a place needs more bits sorts pairs of hash and place.
    pairs_of = F.transform(places, lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("hash"), i.cast("int").alias("place")))
    long_way = F.flatten(F.transform(F.array(F.array_sort(pairs_of)), lambda s: F.transform(doubled(s, lambda x, y: x["hash"] == y["hash"]), lambda x: x["place"])))
    starts = F.when(n < (1 << _PLACES), F.transform(doubled(s, same), place)).otherwise(long_way)
    table = F.when(F.col("trusted"), trusted).otherwise(untrusted).alias("table")
    step = step.select("_row", "h", "lines", "pairs", F.sort_array(starts).alias("starts"), table)
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["sum"] + p + 3 - F.greatest(acc["end"], p)).alias("sum")),
        lambda acc: acc["sum"],
    )

    def total(table: Column) -> Column:
        add = lambda acc, x: acc + table[F.pmod(x, F.lit(BUCKETS)).cast("int")]
        return F.aggregate("pairs", F.aggregate("h", F.lit(0.0), add), add)

    grams = n + F.size("pairs")
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, " " + _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.when(grams > 0, F.transform(F.array("table"), total)[0] / grams).otherwise(0.0).alias("score"),
    )
    # As rows of a generator the counts are formed once; a filter on them would otherwise be pushed down with all its steps.
    step = step.select("_row", F.inline(F.array(counts)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return step.select("_row", F.struct(*[c for c in step.columns if c != "_row"]).alias("quality"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), labels)
    return judged.select("_row.doc_id", "quality.*")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, labels).filter("quality.kept").select("_row.*")
