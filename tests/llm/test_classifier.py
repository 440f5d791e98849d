"""The quality classifier against plain Python, held-out accuracy, and its edge cases."""

import re
import zlib

import numpy as np

from tallyfold.llm import classifier as C
from tallyfold.llm import words as W

from .conftest import prose


def split(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d ]+", text)


def index_vector(word):
    columns, signs = C.index_vectors(W.read([word]).hashes)
    out = np.zeros(C.WIDTH, np.int64)
    np.add.at(out, columns[0], signs[0])
    return out


def bucket(word):
    return int(C._buckets(W.read([word]).hashes)[0])


TEXTS = [b"a, b!! c d", b"", b"one", "é文(x) --".encode(), b"w " * 50, prose(300, 3).encode(), b" \t\n", b"THE!! CAT!!"]


def test_words_are_runs_of_one_kind():
    for text in TEXTS:
        assert [h for h in C.read([text]).hashes] == [int(W.read([w]).hashes[0]) for w in split(text)]


def test_contexts_against_plain_sums(monkeypatch):
    want = np.zeros((C.BUCKETS, C.WIDTH), np.int64)
    for text in TEXTS:
        words = split(text)
        for i, word in enumerate(words):
            for j in range(max(0, i - C.REACH), min(len(words), i + C.REACH + 1)):
                if j != i:
                    want[bucket(word)] += index_vector(words[j])
    assert (C.context_counts(C.read(TEXTS)) == want).all()
    monkeypatch.setattr(C, "PIECE", 7)
    assert (C.context_counts(C.read(TEXTS)) == want).all()


def test_pooling_against_plain_means(monkeypatch):
    table = np.random.default_rng(1).integers(-C.UNIT, C.UNIT, (C.BUCKETS, C.WIDTH)).astype(np.int16)
    got = C.pooled(TEXTS, table)
    for text, row in zip(TEXTS, got):
        words = split(text)
        if not words:
            assert not row.any()
            continue
        vectors = np.array([table[bucket(w)] / C.UNIT for w in words])
        likeness = np.append((vectors[1:] * vectors[:-1]).sum(axis=1), 0)
        vectors = np.column_stack([vectors, likeness])
        want = [*vectors.mean(axis=0), *vectors.std(axis=0), np.log1p(len(words)), len(set(words)) / len(words)]
        assert np.allclose(row, want, atol=1e-3)
    monkeypatch.setattr(C, "PIECE", 5)
    assert (C.pooled(TEXTS, table) == got).all()
    assert (np.concatenate([C.pooled([t], table) for t in TEXTS]) == got).all()


def test_temperature_makes_probabilities_right():
    rng = np.random.default_rng(2)
    true = rng.normal(0, 2, 20_000)
    good = (rng.random(true.size) < 1 / (1 + np.exp(-true))).astype(float)
    assert abs(C._temperature(3 * true, good) - 3) < 0.15


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    for quality in (0, 1):
        assert np.mean([r.predicted == quality for r in rows if r.quality == quality]) > 0.95
    # Probabilities are right on average over the held-out documents.
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.02
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in rows)


def test_result_does_not_depend_on_partitions_or_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    one = sorted(map(tuple, C.scored(docs, labels).collect()))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(encode(cast(doc_id AS string), 'utf-8')) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(tuple, C.scored(docs.repartition(5), other.repartition(3)).collect())) == one


def test_odd_rows(odd, none, labels):
    rows = C.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    assert {r.score for r in C.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert C.scored(none, labels).collect() == []
    both = odd.selectExpr("doc_id", "text").sparkSession.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 1), (11, 1), (6, 5)], "doc_id long, quality int")
    assert C.scored(odd, both).count() == odd.count()
