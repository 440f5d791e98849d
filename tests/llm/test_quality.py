"""Base counts and n-gram ratios against plain Python."""

import math
from collections import Counter

import pytest
import xxhash

from tallyfold.llm import quality as Q


def hash_of(value, seed=42):
    x = xxhash.xxh64(value, seed=seed).intdigest()
    return x - (1 << 64) if x >> 63 else x


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def grams(text):
    h = [hash_of(w.encode()) for w in words_of(text)]
    pairs = []
    for a, b in zip(h, h[1:]):
        seed = hash_of((a & (1 << 64) - 1).to_bytes(8, "little"))
        pairs.append(hash_of((b & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1))
    return [x % Q.BUCKETS for x in h + pairs]


def base(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute(docs, trusted):
    raw, good = Counter(), Counter()
    for d, t in docs:
        g = grams(t or "")
        raw.update(g)
        if d in trusted:
            good.update(g)
    scale = sum(raw.values()) / max(1, sum(good.values()))
    for d, t in docs:
        own = d in trusted
        g = grams(t or "")
        total = sum(math.log((max(good[x] - own, 0) * scale + Q.PRIOR) / (raw[x] - 1 + Q.PRIOR)) for x in g)
        n, chars, symbols, dup, repeat = base(t or "")
        failed = n < 50 or 100 * repeat > 50 * n
        score = total / len(g) if g else 0.0
        yield d, n, chars, symbols, dup, repeat, failed, score


def check(docs, rows, trusted):
    want = sorted(brute(docs, trusted), key=repr)
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score) for r in rows), key=repr)
    assert [x[:7] for x in found] == [x[:7] for x in want]
    assert [x[7] for x in found] == pytest.approx([x[7] for x in want], abs=1e-9)
    assert all(r.kept == (not r.base_failed and r.score >= Q.THRESHOLD) for r in rows)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    check([(r.doc_id, r.text) for r in docs.collect()], Q.verdicts(docs, labels).collect(), trusted)


def test_texts_of_more_windows_than_places_have_bits(spark, monkeypatch):
    monkeypatch.setattr(Q, "_PLACES", 5)
    texts = ["a b c " * 30, "x " * 40, " ".join(f"w{i % 17}" for i in range(90)), " ".join(f"w{i}" for i in range(60)), "a b c a b c", "p q r s " + "t u v " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = Q.verdicts(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {i: base(t)[4] for i, t in enumerate(texts)}


def test_odd_rows(odd, none, labels):
    check([(r.doc_id, r.text) for r in odd.collect()], Q.verdicts(odd, labels).collect(), {1, 8})
    assert Q.kept_documents(odd, labels).columns == odd.columns
    assert Q.verdicts(none, labels).collect() == []
    assert all(r.score == 0 for r in Q.verdicts(odd, labels.limit(0)).collect())


def test_no_python_in_the_plan(odd, labels):
    plan = Q.verdicts(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_plan_does_not_spell_out_the_tables(odd, labels):
    plan = Q.kept_documents(odd, labels)._jdf.queryExecution().toString()
    assert len(plan) < 10 * Q.BUCKETS


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.verdicts(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)
    assert not any(r.kept for r in rows if r.quality == 0)
