"""Order MinHash against exact edit similarity, and its edge cases."""

import random

import numpy as np

from tallyfold.llm import order_minhash as M
from tallyfold.llm import words as W

from .conftest import prose


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert M.common_length(a, b, 40) == lcs(a, b)


def test_similarity_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() > 0.12]
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        if not b:
            continue
        exact = lcs(a, b) / max(len(a), len(b))
        found = M.similar(np.array(a, np.uint64), np.array(b, np.uint64))
        assert found == (exact if exact >= 0.8 else 0)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_classes_against_all_pairs(spark):
    texts = [prose(120, i) for i in range(30)]
    texts += [edited(texts[i % 10], 0.03, i) for i in range(25)] + [texts[0]] * 5
    # A passage that many otherwise different short documents share, and parts of a text in another order.
    passage = prose(12, 99)
    texts += [passage + " " + prose(25, 200 + i) for i in range(60)]
    half = texts[3].split()
    texts.append(" ".join(half[60:] + half[:60]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in M.near_copies(docs).collect()}
    hashes = [W.read([t.encode()]).hashes for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if lcs_bound(hashes[i], hashes[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert found == {i: root(i) for i in range(len(texts))}


def test_bridge_to_a_member_that_left_its_bucket(spark):
    words = prose(100, 7).split()
    texts = [" ".join(words)]
    for i in range(120):
        at = 15 + i % 65
        texts.append(" ".join(words[:at] + [f"own{i}x{j}" for j in range(8)] + words[at + 8 : 90]))
    # All lie in the class of the first; the last is similar to the one before it only.
    texts += [" ".join(words[:90]), " ".join(words[15:90])]
    hashes = [W.read([t.encode()]).hashes for t in texts]
    assert [i for i in range(len(texts) - 1) if lcs_bound(hashes[i], hashes[-1])] == [len(texts) - 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.class_id for r in M.near_copies(docs).collect()} == {0}


def lcs_bound(a, b):
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and M.common_length(a.tolist(), b.tolist(), max(len(a), len(b))) >= 0.8 * max(len(a), len(b))


def test_components_join_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    found = {r.node: r.class_id for r in M.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_odd_rows(odd, none):
    rows = M.near_copies(odd).collect()
    classes = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11}
    assert sum(r.doc_id is None for r in rows) == 2
    assert M.near_copies(none).collect() == []


def test_linked_texts_share_a_rare_word():
    rng = random.Random(4)
    counts = np.array([rng.randrange(50) for _ in range(M.COUNTED)])
    for _ in range(300):
        a = [rng.randrange(60) for _ in range(rng.randrange(1, 70))]
        b = [x for x in a if rng.random() > 0.1] or a
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(60))
        x, y = (W.mix(np.array(t, np.uint64) + np.uint64(1)) for t in (a, b))
        differ = len(a) + len(b) - 2 * sum(min(a.count(w), b.count(w)) for w in set(a))
        assert int(np.bitwise_count((M.word_map(x) ^ M.word_map(y)).view(np.uint64)).sum()) <= differ
        if M.similar(x, y):
            assert np.intersect1d(M.rare_words(x, counts), M.rare_words(y, counts)).size


def test_a_group_of_a_third_of_all_documents(spark):
    base = prose(60, 1)
    texts = [prose(50, 1000 + i) for i in range(400)] + [edited(base, 0.04, i) for i in range(180)] + [base] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in M.near_copies(docs).collect()}
    assert all(found[i] == i for i in range(400)) and {found[i] for i in range(400, 600)} == {400}


def test_repeated_ids_give_the_same_classes_in_any_order(spark):
    a, b = prose(80, 1), prose(80, 2)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, a + " end"), (4, b + " end")]
    results = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(1)
        results.add(tuple(sorted((r.doc_id, r.class_id, r.n_links) for r in M.near_copies(docs).collect())))
    assert len(results) == 1 and len(next(iter(results))) == 4


def test_hot_keys_can_be_split(spark):
    rows = spark.range(1000).selectExpr("id % 2 AS key", "id AS rep")
    plan = rows.hint("merge").join(M.spread(rows.groupBy("key").count()), "key")._jdf.queryExecution().executedPlan().toString()
    # An exchange of its own lies between the join and the aggregate.
    assert "REPARTITION_BY_COL" in plan and plan.index("ENSURE_REQUIREMENTS") < plan.index("REPARTITION_BY_COL") < plan.index("HashAggregate")


def mixed_buckets():
    """Documents that share a passage, in small groups and in a large one, each group with edited copies of its members."""
    texts = []
    for group, members in enumerate((3, 4, 5, 40)):
        passage = prose(40, 500 + group)
        for i in range(members):
            text = f"{passage} {prose(30, 600 + 50 * group + i)}"
            texts += [text, edited(text, 0.03, i)] if i % 2 else [text]
    return texts


def test_narrow_and_wide_buckets_give_the_same_links(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(mixed_buckets())), "doc_id long, text string").repartition(3)
    found = []
    for most in (0, M.NARROW, 10**6):
        monkeypatch.setattr(M, "NARROW", most)
        found.append(sorted(tuple(r) for r in M.near_copies(docs).collect()))
    assert found[0] == found[1] == found[2]
    assert len({r[1] for r in found[0]}) < len(found[0])


def test_members_of_narrow_buckets_have_no_rows_under_words(spark, monkeypatch):
    tables, plain = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: tables.append(plain(df)) or tables[-1])
    docs = spark.createDataFrame(list(enumerate(mixed_buckets()[:17])), "doc_id long, text string").repartition(3)
    M.near_copies(docs).collect()
    filed = next(t for t in tables if "words" in t.columns)
    assert filed.count() > 0
    assert [t.count() for t in tables if "before" in t.columns] == [0]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tables, plain = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: tables.append(1) or plain(df))
    stars = spark.createDataFrame([(10 * i, 10 * i + j) for i in range(5) for j in range(1, 9)], "a long, b long")
    assert {r.node: r.class_id for r in M.components(stars).collect()} == {10 * i + j: 10 * i for i in range(5) for j in range(9)}
    assert len(tables) == 1


def test_components_against_union_by_hand(spark):
    rng = random.Random(5)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, 149 - i) for i in range(20)] + [(7, 7)]
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = M.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.class_id) for r in found) == sorted((i, root(i)) for i in nodes)


def test_words_of_one_text_are_not_filed():
    x, y = (W.read([t.encode()]).hashes for t in (prose(50, 1) + " only here", prose(50, 1) + " or there"))
    counts = np.zeros(M.COUNTED, np.int64)
    for h in (x, y):
        np.add.at(counts, M._tokens(h)[1], 1)
    left, right = M.shared_words(x, counts), M.shared_words(y, counts)
    assert set(left) & set(right) == set(M.rare_words(x, counts)) & set(M.rare_words(y, counts)) != set()
    assert len(left) < len(M.rare_words(x, counts))
