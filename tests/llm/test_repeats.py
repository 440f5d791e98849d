"""Repeated windows against brute force."""

import hashlib
import random

from tallyfold.llm import repeats as R

from .conftest import prose


def expected(docs, n=13):
    first = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(docs):
    return sorted(map(tuple, R.digests(R.remove_repeats(docs)).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(k, 50 + k) for k in (12, 13, 14, 20, 60, 200)]
    docs = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 40), 1000 + i)]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), prose(rng.randrange(0, 15), 2000 + i * 7 + len(parts))]
        docs.append((i, "  \n".join(parts)))
    docs += [(60, "again " * 50), (61, "again " * 20), (62, None), (63, "")]
    found = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(found) == expected(docs)


def test_odd_rows(odd, none):
    assert result(odd) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert result(none) == []


def test_spans_cover_what_was_removed(spark):
    passage = prose(40, 1)
    docs = [(1, passage), (2, "a b c " + passage + " d e")]
    rows = {r.doc_id: r for r in R.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in rows[2].spans] == [(3, 43)]
    assert rows[2].kept_text == "a b c d e" and rows[1].spans == []


def test_doubling_goes_on_until_no_candidate_survives(spark):
    docs = [(1, prose(300, 1)), (2, "x " + prose(300, 1)), (3, prose(30, 1)), (4, prose(100, 9)), (5, prose(14, 1))]
    found = {r.doc_id: r.longest for r in R.deepest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: 208, 2: 208, 3: 26, 5: 13}
