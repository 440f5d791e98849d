"""The Merkle manifest against a plain tree in Python, and its edge cases."""

import hashlib
import zlib

import pytest

from tallyfold.llm import manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for name in M.FIELDS:
        value = row[name]
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def tree(nodes):
    """The root, and for each node its siblings, level by level."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in under[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append(sum(under[a : a + 3], []))
        nodes, under = above, held
    return nodes[0], ways


def plain(rows):
    first = lambda x: (x is not None, x if x is None else x.encode() if isinstance(x, str) else x)
    found = []
    sources = sorted({r["source"] for r in rows}, key=first)
    for source in sources:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (*first(r["doc_id"]), leaf(r)) if r["doc_id"] is not None else (False, 0, leaf(r)))
        subroot, ways = tree([leaf(r) for r in own])
        found.append((own, subroot, ways))
    root, tops = tree([x[1] for x in found])
    out = []
    for (own, subroot, ways), top in zip(found, tops):
        for row, way in zip(own, ways):
            seen = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                seen["text"] = row["text"].replace("\n", "")
            folded = leaf(seen)
            for left, right in way + top:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in way + top))
            out.append((row["doc_id"], row["source"], leaf(row), subroot, root, proof, folded, folded == root))
    return out


def compared(df):
    got = [tuple(r) for r in M.manifest(df).drop("proof").collect()]
    want = plain([r.asDict() for r in df.collect()])
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


@pytest.mark.parametrize("depth", [1, 2])
def test_against_a_plain_tree_over_several_rounds(spark, depth, monkeypatch):
    monkeypatch.setattr(M, "DEPTH", depth)
    monkeypatch.setattr(M, "BLOCK", 3**depth)
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 9, 10, 28, 82, 5, 1, 1]):
        rows += [(1000 * k + i * 7, f"a\nb{i}" if i % 3 else "c", "en", f"s{k}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = compared(df)
    assert {r[-1] for r in got} == {True, False}


def test_one_leaf_and_one_source(spark):
    df = spark.createDataFrame([(5, "x\ny", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    row = compared(df)[0]
    assert row[2] == row[3] == row[4] and row[5] == sha("")


def test_one_source_holds_a_third(spark):
    rows = [(i, f"t{i}\n", None, "hot" if i % 3 == 0 else f"s{i % 40}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    compared(df)


def test_odd_rows(odd, none):
    got = compared(odd)
    assert len(got) == 14 and M.manifest(none).collect() == []


def test_proofs_are_emitted_without_joins(spark, small, monkeypatch):
    frames = []
    plain_unrolled = M.unrolled
    monkeypatch.setattr(M, "unrolled", lambda *a: frames.append(plain_unrolled(*a)) or frames[-1])
    M.manifest(spark.read.parquet(f"{small}/documents.parquet"))
    for frame in frames:
        assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
