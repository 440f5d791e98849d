"""Merkle manifest of a dataset: one root over all documents, and a proof for each of them.

The leaves of a source stand in the order of their ids; three consecutive nodes become one until a single one, the subroot, is
left, and the subroots, in the order of their sources, likewise become the root.

A node's place in base three gives its digit columns. Within a block of ``BLOCK`` neighbours, which one row holds, these columns are grouped away
one after the other: each group's nodes become the children inside the struct of their parent. The blocks' own nodes are the leaves
of the next round, so rounds are few and no row grows with the data. The way back is a transform that unfolds the structs level by level and
notes the siblings, and an explode; the path above a block reaches it as one more row of its group, not by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.shared import stored
from tallyfold.plans.ordering import attach

ARITY = 3
DEPTH = 6
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row: each field as its byte count, a colon and its value, a null as a dash."""

    def field(value: Column) -> Column:
        plain = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))

    return digest(*[field(values[c]) for c in FIELDS])


def leaves(docs: DataFrame) -> DataFrame:
    """``source``, ``doc_id``, ``hash`` and ``seen``: the leaf as recorded, and as a reader finds it after the tampering that the manifest
    is to show: in documents whose id has an even CRC-32, line feeds are gone from the text."""
    plain = {c: F.col(c) for c in FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = plain | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    changed = even & F.contains("text", F.lit("\n"))
    found = docs.select("source", "doc_id", leaf(plain).alias("hash"), F.when(changed, leaf(cut)).alias("cut"))
    return found.select("source", "doc_id", "hash", F.coalesce("cut", "hash").alias("seen"))


def ranked(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, the place in the tree from 0 on, and ``total``, the nodes of the tree. The rows are cut into ranges of the order, each
    numbers its own rows, and a tree's counts in the ranges before are added. A hot tree spreads over many ranges."""
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    cut = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = stored(cut.withColumns({"part": F.spark_partition_id(), "place": place}))
    runs = cut.groupBy("part", tree).agg(F.min("place").alias("start"), F.count("*").alias("rows"))
    whole = Window.partitionBy(tree)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "part", tree, (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("rows").over(whole).alias("total")
    )
    found = attach(cut, runs, ["part", tree]).withColumn("rank", F.col("place") + F.col("shift"))
    return found.drop("part", "place", "shift")


def _merged(level: int) -> Column:
    """Whether a tree of ``total`` leaves still has several nodes below this level, so that they become their digest."""
    return F.col("total") > ARITY ** (level - 1)


def rolled(nodes: DataFrame, tree: str, done: int) -> DataFrame:
    """One row per block: ``tree``, ``rank`` (of the block), ``total``, ``node``: the struct of the block's node with all nodes below it
    inside. ``nodes`` have ``tree``, ``rank``, ``total`` and a struct ``node`` with a ``hash``, on level ``done`` of their trees."""
    digits = {f"digit{i}": F.expr(f"rank div {ARITY**i} % {ARITY}") for i in range(DEPTH)}
    rows = nodes.withColumns(digits).withColumn("rank", F.expr(f"rank div {BLOCK}"))
    rows = rows.select(tree, "rank", "total", *digits, "node").repartition(tree, "rank")
    for i in range(DEPTH):
        keys = [tree, "rank", "total", *[f"digit{k}" for k in reversed(range(i + 1, DEPTH))]]
        kids = [F.first(F.when(F.col(f"digit{i}") == k, F.col("node")), True) for k in range(ARITY)]
        rows = rows.groupBy(*keys).agg(F.array_compact(F.array(*kids)).alias("kids"))
        joined = F.array_join(F.col("kids.hash"), "")
        up = F.when(_merged(done + i + 1), digest(joined)).otherwise(joined)
        rows = rows.withColumn("node", F.struct(up.alias("hash"), "kids")).drop("kids")
    return rows.select(tree, "rank", "total", "node")


def _kids(level: int) -> Callable[[Column], Column]:
    """The children of an open node, each with the siblings that this level adds to its path."""

    def kids(x: Column) -> Column:
        hashes = x["node"]["kids"]["hash"]

        def kid(k: Column, i: Column) -> Column:
            left = F.array_join(F.slice(hashes, 1, i), "")
            right = F.array_join(F.slice(hashes, i + 2, ARITY), "")
            own = F.array(F.struct(left.alias("left"), right.alias("right")))
            own = F.when(_merged(level), own).otherwise(F.array().cast(_PATH))
            return F.struct(k.alias("node"), (x["at"] * ARITY + i).alias("at"), F.concat(own, x["path"]).alias("path"))

        return F.transform(x["node"]["kids"], kid)

    return kids


def unrolled(blocks: DataFrame, tree: str, done: int, *others: str) -> DataFrame:
    """The nodes that ``rolled`` nested: ``tree``, ``rank``, ``total``, ``node``, ``path`` (siblings on the left and on the right, level by
    level, up to the root) and the other columns of the block, whose own ``path`` they continue."""
    start = F.array(F.struct("node", F.lit(0).cast("long").alias("at"), F.array().cast(_PATH).alias("path")))
    rows = blocks.select(tree, "rank", "total", F.col("path").alias("above"), *others, start.alias("open"))
    for level in range(done + DEPTH, done, -1):
        rows = rows.withColumn("open", F.flatten(F.transform("open", _kids(level))))
    rows = rows.withColumn("open", F.explode("open"))
    return rows.select(
        tree,
        (F.col("rank") * BLOCK + F.col("open.at")).alias("rank"),
        "total",
        F.col("open.node").alias("node"),
        F.concat("open.path", "above").alias("path"),
        *others,
    )


def _rounds(nodes: DataFrame, tree: str) -> list[DataFrame]:
    """The blocks of each round, the last of which has one block per tree."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    rounds = [stored(rolled(nodes, tree, 0))]
    while most > BLOCK ** len(rounds):
        tops = rounds[-1].select(tree, "rank", "total", F.struct("node.hash").alias("node"))
        rounds.append(stored(rolled(tops, tree, DEPTH * len(rounds))))
    return rounds


def _proved(rounds: list[DataFrame], top: DataFrame, tree: str, *others: str) -> DataFrame:
    """The nodes under ``rounds`` with their paths. ``top``: a row per tree with its ``path`` from there on and other columns. A block and
    the path above it meet as two rows of one group."""
    known = top.select(tree, F.lit(0).cast("long").alias("rank"), "path", *others)
    for done in range(len(rounds) - 1, -1, -1):
        blocks = rounds[done].unionByName(known, allowMissingColumns=True)
        parts = [c for c in blocks.columns if c not in (tree, "rank")]
        blocks = blocks.groupBy(tree, "rank").agg(*[F.first(c, True).alias(c) for c in parts])
        known = unrolled(blocks, tree, DEPTH * done, *others)
        if done:
            known = stored(known.select(tree, "rank", "path", *others))
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings from the leaf to the root, each level's left ones before its right ones),
    ``proof_sha256``, ``folded_root``, ``verified``: one row per document.

    Null fields count as a dash; a null source is a tree of its own, before all others; null ids stand first in theirs and are
    never tampered with. Rows that repeat an id follow each other by their leaves, and equal rows are leaves of their own. An empty
    table has no rows. Other columns are not part of a leaf. A text of any length costs its own size once per digest.
    """
    base = ranked(stored(leaves(docs)), "source", ["doc_id", "hash"])
    under = _rounds(base.select("source", "rank", "total", F.struct("hash", "doc_id", "seen").alias("node")), "source")
    subroots = under[-1].select(F.lit(0).alias("all"), "source", F.col("node.hash").alias("hash"))
    tops = ranked(subroots, "all", ["source"])
    over = _rounds(tops.select("all", "rank", "total", F.struct("hash", "source").alias("node")), "all")
    root = over[-1].select("all", F.array().cast(_PATH).alias("path"), F.col("node.hash").alias("root"))
    sources = _proved(over, root, "all", "root").select(
        F.col("node.source").alias("source"), "path", F.col("node.hash").alias("subroot"), "root"
    )
    found = _proved(under, stored(sources), "source", "subroot", "root")
    folded = F.aggregate("path", F.col("node.seen"), lambda h, x: digest(x["left"], h, x["right"]))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = found.select(
        F.col("node.doc_id").alias("doc_id"),
        "source",
        F.col("node.hash").alias("leaf"),
        "subroot",
        "root",
        F.col("path").alias("proof"),
        digest(siblings).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_ROW = " || ".join(_FIELD.format(c) for c in FIELDS)
_STEP = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {_STEP}), 4294967295)"


def _tree(name: str, start: str) -> str:
    """Nodes of all levels of a tree, and each node's siblings on both sides."""
    near = f"string_agg(h, '') OVER (PARTITION BY tree, level, pos // {ARITY} ORDER BY pos ROWS BETWEEN %s)"
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT tree, level + 1, pos // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + {ARITY - 1}) // {ARITY})
        FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {ARITY}
    ), {name}_near AS (
        SELECT *, coalesce({near % 'UNBOUNDED PRECEDING AND 1 PRECEDING'}, '') AS l,
            coalesce({near % '1 FOLLOWING AND UNBOUNDED FOLLOWING'}, '') AS r
        FROM {name}
    )"""


def _walk(name: str, tree: str, start: str) -> str:
    """Ways from the start rows up to the top of their tree."""
    return f"""{name} AS (
        {start}
        UNION ALL
        SELECT w.tree, w.own, w.level + 1, w.pos // {ARITY}, proof || l || r, sha256(l || cur || r), w.n
        FROM {name} w JOIN {tree}_near t ON t.tree IS NOT DISTINCT FROM w.tree AND t.level = w.level AND t.pos = w.pos
        WHERE t.n > 1
    )"""


ORACLE = f"""WITH RECURSIVE leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT doc_id, source, sha256({_ROW}) AS leaf,
            CASE WHEN {_CRC} % 2 = 0 THEN sha256({_ROW.replace(_FIELD.format("text"), _FIELD.format("replace(text, chr(10), '')"))}) ELSE sha256({_ROW}) END AS seen
            FROM documents)
    ), {_tree("low", "SELECT source AS tree, 0 AS level, pos, leaf AS h, n FROM leaves")},
    subs AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM low WHERE n = 1),
    {_tree("high", "SELECT 0 AS tree, 0 AS level, place AS pos, subroot AS h, m AS n FROM subs")},
    {_walk("up", "low", "SELECT source AS tree, pos AS own, 0 AS level, pos, '' AS proof, seen AS cur, n FROM leaves")},
    ends AS (SELECT tree AS source, own, max_by(proof, level) AS proof, max_by(cur, level) AS cur FROM up GROUP BY tree, own),
    {_walk("over", "high", '''SELECT 0 AS tree, struct_pack(source := e.source, own := e.own) AS own, 0 AS level, s.place AS pos, e.proof, e.cur, s.m AS n
        FROM ends e JOIN subs s ON s.source IS NOT DISTINCT FROM e.source''')},
    tops AS (SELECT own.source AS source, own.own AS own, max_by(proof, level) AS proof, max_by(cur, level) AS cur FROM over GROUP BY own)
SELECT doc_id, l.source, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(t.proof) AS proof_sha256, t.cur AS folded_root,
    t.cur = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source
    JOIN tops t ON t.source IS NOT DISTINCT FROM l.source AND t.own = l.pos
"""
