"""Mixing of sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words. A document is taken as often as its source's target holds all its words
(whole copies), and the words still wanted come from an ordered sample. Every document has an inclusion probability: a factor of its source times a measure that falls
with its length, one at most. The factor is solved so that the expected words are those wanted, over the counts of each size. Documents with
probability one are certain; the others are ranked by random odds over inclusion odds, and the first ones that fill the remainder
get one copy more.

Only sizes and ranks are shuffled. Running totals are formed in slices of a source, so a source of a third of all rows is
many tasks; what returns to the documents is one row per source with the rank at which its sample ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.shared import n_words, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: A document of this many words is half as likely as a very short one: long ones overshoot a target more.
HALF_ODDS = 1000
#: Documents whose running total one task forms, about.
SLICE = 5000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` -> the same and ``weight``, ``target``.

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all sizes by weight; none is above ``most`` times its
    source, and what is cut off there is shared again. Sources in the order of most size per weight: those up to a point stop at
    their limit, and one level serves all after it."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    named = named.withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    named = named.select("*", ((whole * share - before) / after).alias("level"))
    named = named.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    return named.select("source", "source_size", "weight", target.alias("target"))


def _chance(seed: str) -> Column:
    """A number in (0, 1) from the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _measure() -> Column:
    return HALF_ODDS / (F.col("size") + float(HALF_ODDS))


def solved(counts: DataFrame) -> DataFrame:
    """Per source the ``factor`` that makes the expected words those wanted, ``open`` (the least size that is not certain), ``left`` (words wanted of
    such documents) and ``typical`` (their odds against inclusion on average). ``counts`` have ``source``, ``size``, ``n`` and the words wanted as ``rest``.

    The measure falls with the size, so the certain sizes are the smallest: a size is certain if, with all smaller ones certain, its own
    probability reaches one."""
    words = F.col("size") * F.col("n")
    up = Window.partitionBy("source").orderBy("size")
    here = up.rowsBetween(0, Window.unboundedFollowing)
    smaller = F.coalesce(F.sum(words).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.filter("rest > 0").select(
        "source", "size", (F.col("rest") - smaller).alias("left"), F.sum(words * _measure()).over(here).alias("weighted"), F.sum(words).over(here).alias("words")
    )
    rows = rows.filter("weighted > 0").withColumn("factor", F.col("left") / F.col("weighted"))
    first = rows.filter(F.col("factor") * _measure() < 1).groupBy("source").agg(F.min(F.struct("size", "factor", "left", "words")).alias("x"))
    return first.select(
        "source", F.col("x.size").alias("open"), "x.factor", "x.left", ((F.col("x.words") - F.col("x.left")) / F.col("x.left")).alias("typical")
    )


def _rank(seed: str) -> Column:
    """A number in [0, 1) that grows with random odds over inclusion odds, spread about evenly over a source."""
    odds = F.col("factor") * _measure() / (1 - F.col("factor") * _measure())
    value = _chance(seed) / (1 - _chance(seed)) / odds
    return value / (value + F.col("typical"))


def _key() -> Column:
    return F.struct("rank", "doc_id", "size", "mark")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow columns, and one row per source: target, whole copies, solved factor, last key of the sample."""
    sized = stored(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("mark")))
    counts = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    facts = targets(sources.select("source", "source_size"), weights, share)
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = facts.withColumn("whole", F.floor(share_of)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    facts = stored(_meet(facts, sources.select("source", "n")).withColumn("slices", F.ceil(F.col("n") / SLICE)))
    factors = solved(_meet(counts, facts.select("source", "rest")))
    facts = stored(_meet(facts, factors, how="left"))
    ranked = _meet(sized, facts.select("source", "factor", "open", "left", "typical", "slices")).filter("size >= open AND left > 0")
    ranked = ranked.withColumn("rank", _rank(seed)).withColumn("slice", F.floor(F.col("rank") * F.col("slices")))
    totals = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"), "words")
    # Only the slice in which a remainder ends is looked at row by row; slices before it belong to the sample as a whole.
    ranked = _meet(ranked, totals.withColumnRenamed("slice", "at"), F.col("slice") == F.col("at")).filter("before < left")
    run = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    taken = ranked.withColumn("upto", F.col("before") + F.sum("size").over(run)).filter(F.col("upto") - F.col("size") / 2.0 <= F.col("left"))
    last = taken.groupBy("source").agg(F.max(_key()).alias("last"))
    wanted = facts.select("source", "source_size", "target", "whole", "factor", "open", "typical")
    return sized, stored(_meet(wanted, last, how="left"))


def _meet(rows: DataFrame, facts: DataFrame, also=None, how: str = "inner") -> DataFrame:
    """Join by source, null being a source too."""
    facts = facts.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(facts, on if also is None else on & also, how).drop("_source")


def _copies(seed: str) -> Column:
    """Whole copies, and one more if the document is certain or not behind the end of its source's sample."""
    ranked = F.struct(_rank(seed).alias("rank"), "doc_id", "size", "mark")
    more = (F.col("size") < F.col("open")) | (F.col("last").isNotNull() & (ranked <= F.col("last")))
    return (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes) and ``copies``, one row per document.

    A null text has no words and, like an empty one, adds nothing; a null source is a source; a source without words has target 0. Rows that
    repeat both id and text share their random number and are taken together. Other columns are ignored."""
    sized, facts = plan(docs, weights, share, seed)
    rows = _meet(sized, facts).withColumn("copies", _copies(seed))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    _, facts = plan(docs, weights, share, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select(row, "doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("mark"))
    rows = _meet(marked, facts).withColumn("copies", _copies(seed)).filter("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS chance
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2 * source_size AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size,
    CASE WHEN cap <= level * weight THEN cap::DOUBLE
      ELSE weight * (SELECT l.level FROM levels l WHERE l.cap > l.level * l.weight ORDER BY l.cap / l.weight, l.source NULLS LAST LIMIT 1) END AS target
  FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), steps AS (
  SELECT c.*, p.source_size, p.rest, {HALF_ODDS} / (size + {HALF_ODDS}.0::DOUBLE) AS measure,
    rest - coalesce(sum(size * n) OVER (PARTITION BY c.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(size * n * ({HALF_ODDS} / (size + {HALF_ODDS}.0::DOUBLE))) OVER (PARTITION BY c.source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighted
  FROM (SELECT source, size, count(*) AS n FROM sized GROUP BY source, size) c
    JOIN (SELECT *, target - whole * source_size AS rest FROM parts) p ON c.source IS NOT DISTINCT FROM p.source WHERE rest > 0
), factors AS (
  SELECT source, min(size) AS open_, min_by(left_ / weighted, size) AS factor, min_by(left_, size) AS left_
  FROM steps WHERE weighted > 0 AND left_ / weighted * measure < 1 GROUP BY source
), ranked AS (
  SELECT s.*, f.open_, f.left_, chance / (1 - chance) * (1 - factor * ({HALF_ODDS} / (size + {HALF_ODDS}.0::DOUBLE))) / (factor * ({HALF_ODDS} / (size + {HALF_ODDS}.0::DOUBLE))) AS odds
  FROM sized s JOIN factors f ON s.source IS NOT DISTINCT FROM f.source WHERE size >= open_ AND left_ > 0
), running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), more AS (
  SELECT doc_id, source, size, chance FROM running WHERE upto - size / 2.0::DOUBLE <= left_
  UNION ALL SELECT s.doc_id, s.source, s.size, s.chance FROM sized s JOIN factors f ON s.source IS NOT DISTINCT FROM f.source WHERE s.size < open_
), copied AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, (p.whole + CASE WHEN m.doc_id IS NOT NULL THEN 1 ELSE 0 END)::INT AS copies
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN more m ON m.doc_id = s.doc_id AND m.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM copied
"""
