"""The pipeline's stages: columns, effect, and the whole against its parts."""

from collections import Counter

import corpus_pipeline
from tallyfold.llm import order_minhash, quality


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs, labels).filter("kept").collect()}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], small).collect(), docs.schema))
        assert steps[-1].columns == docs.columns, name
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    assert set(ids[1]) == kept
    classes = {r.doc_id: r.class_id for r in order_minhash.near_copies(steps[1]).collect()}
    assert set(ids[2]) == set(classes.values()) and ids[3] == ids[2]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[4], small).collect()
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert set(length) == set(ids[4])
    whole = corpus_pipeline.run(spark, small).selectExpr("doc_id", "length").collect()
    total = Counter()
    for r in whole:
        total[r.doc_id] += r.length
    assert total == length


def test_stages_with_odd_rows(spark, odd, small):
    docs = odd.drop("n_words")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    texts = lambda found: Counter((r.doc_id, r.text) for r in found)

    judged = quality.judge(docs, labels).filter("quality.kept").select("_row.doc_id", "_row.text").collect()
    kept = stages["quality_rules"](spark, docs, small)
    assert kept.columns == docs.columns and texts(kept.collect()) == texts(judged) and texts(judged) <= texts(rows)

    # Rows 1 and 2 are copies, id 8 is repeated, two rows have no id; everything else stays.
    single = stages["near_dedup"](spark, docs, small)
    ids = Counter(r.doc_id for r in single.collect())
    assert single.columns == docs.columns and ids == {None: 2, **dict.fromkeys([1, 3, 4, 5, 6, 7, 8, 9, 10, 11], 1)}
    assert texts(single.collect()) <= texts(rows)

    private = stages["private_data"](spark, docs, small)
    assert private.columns == docs.columns and sorted(map(repr, private.collect())) == sorted(map(repr, rows))

    mixed = stages["source_mix"](spark, docs, small)
    found = texts(mixed.collect())
    assert mixed.columns == docs.columns and all(n <= 2 * texts(rows)[k] for k, n in found.items())

    packed = Counter()
    for r in stages["packing"](spark, docs, small).collect():
        packed[r.doc_id] += r.length
    assert set(packed) == {r.doc_id for r in rows} and packed[6] == 2
    for stage in stages.values():
        assert stage(spark, docs.limit(0), small).count() == 0


def test_kept_row_of_a_repeated_id_does_not_depend_on_the_order(spark, small):
    rows = [(1, "b c d", "x"), (1, "a b c", "y"), (1, "b c d", "z")]
    found = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(1)
        found |= set(map(tuple, dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, small).collect()))
    assert len(found) == 1
