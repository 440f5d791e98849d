"""Ranked lexical search against scoring every document, and its edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyfold.llm import ranked_search as M

from .conftest import prose

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(LOWER) for t in PATTERN.findall(text or "")]


def plain(docs, items, top=20):
    docs = [(i, Counter(split(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m, score = 75 + 25 * n * n_docs // total, 0
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i))
        scores.sort(key=lambda x: x[:2] if x[2] is None else x)
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores[:top])]
    return out


def found(spark, docs, items, parts=3, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in M.search(docs, items, **options).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_terms():
    for text in ["Ab-cÉ d\x85e\u00a0f 9_x[y]\x00z", "", "文字,文", "A" * 1000, "\x7fa\x80"]:
        assert [t.decode() for t in M.terms(text.encode())] == split(text)


def test_against_scoring_all(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(12)] + [(20, " ".join(words)), (21, "w1 w1 w1 none"), (22, "none")]
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, pairs=30) == want
    assert found(spark, docs, items, top=3) == plain(docs, items, 3)


def test_masks_are_left_out_when_their_bound_is_too_low():
    rng = np.random.default_rng(1)
    n = 5000
    # One rare and heavy term, nine frequent and light ones.
    lists = [[0] * (i % 100 == 0) + [t for t in range(1, 10) if rng.random() < 0.5] for i in range(n)]
    batch = pa.record_batch(
        {
            "doc_id": pa.array(range(n), pa.int64()),
            "m": pa.array([100] * n, pa.int64()),
            "terms": pa.array(lists, pa.list_(pa.int32())),
            "counts": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int64())),
        }
    )
    share = M.SCALE // (M.SLOPE + M.LENGTH * 100)
    gains = np.array([9000] + [10] * 9, np.int64)
    item = M.Item(np.arange(10), np.ones(10, np.int64), gains, gains * share)
    rows, scores = M.best_of(M.Batch(batch), item, 1, 20)
    exact = np.array([sum(int(gains[t]) * share for t in x) for x in lists])
    least = np.sort(exact)[-20]
    assert set(rows) == set(np.flatnonzero(exact >= least)) and (scores == exact[rows]).all()
    taken = []
    ready = M.Batch(batch)
    ready.of, real = lambda number: taken.append(number) or real(number), ready.of
    M.best_of(ready, item, int(exact.max()) + 1, 20)
    assert len(taken) == 10  # only the masks are set, nothing is scored


def test_odd_rows(spark, odd, none):
    items = [(1, "one Word word"), (None, "alpha1 beta2 ünïcödé"), (3, None), (4, ""), (5, "🙂 文字"), (6, prose(200, 2)), (6, prose(200, 2))]
    rows = M.search(odd, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score")).collect()
    want = plain([(r.doc_id, r.text) for r in odd.collect()], items[:-1])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert M.search(none, asked).collect() == [] and M.search(odd, asked.limit(0)).collect() == []
