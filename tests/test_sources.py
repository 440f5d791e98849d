import csv
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import retrieval, turns
from tallyfold.plans.scale import Scale
from tallyfold.sources import readers, sinks
from tallyfold.streaming.ingest import default_stages, ingest_folder, manifest, read_stage, run_stages

TINY = Scale(chunk_rows=11, bins=8)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_of_any_delimiter(spark, tmp_path, sep):
    lines = [sep.join(["id", "name", "price", "ok"])]
    lines += [sep.join([str(i), f"n {i}", f"{i}.5", "true"]) for i in range(20)]
    lines.insert(5, sep.join(["99", "bad", "1", "true", "surplus", "more"]))
    lines.insert(9, sep.join(["98", "short"]))
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines) + "\n")
    assert readers.sniff_delimiter(spark, str(path)) == sep
    df = readers.read_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "ok": "boolean"}
    assert df.count() == 21 and df.filter("id = 98 and price is null").count() == 1
    assert readers.count_bad_lines(spark, str(path)) == 1


def test_csv_with_quoted_line_breaks_in_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            rows = csv.writer(out, lineterminator="\n")
            rows.writerow(["id", "text", "x\ny", "n"])
            for i in range(500):
                text = "".join(rng.choice(["a", "b", '"', "\n", ",", ";", " ", "\r\n"]) for _ in range(rng.randrange(1, 40)))
                rows.writerow([f * 1000 + i, text, rng.choice(["p", "q\n\n", '"']), i / 2])
                want.append((f * 1000 + i, text, i / 2))
                if i % 100 == 7:
                    rows.writerow([-1, "bad", "c", 1, "more", "z\nz"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.sniff_delimiter(spark, str(tmp_path)) == ","
        assert readers.csv_records(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
        df = readers.read_csv(spark, str(tmp_path), ",")
        assert df.columns == ["id", "text", "x\ny", "n"]
        assert sorted((r[0], r[1], r[3]) for r in df.collect()) == sorted(want)
        surplus = readers.surplus_records(spark, str(tmp_path), ",").collect()
        assert len(surplus) == 10 and {r["record"] for r in surplus} == {'-1,bad,c,1,more,"z\nz"'}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root, pointers = str(tmp_path / "data"), str(tmp_path / "pointers")
    real = sinks.save_new
    failed = []

    def second_writer(df, path, file_type):
        monkeypatch.setattr(sinks, "save_new", real)
        try:
            sinks.replace_version(spark.range(9), root, "d", pointers)
        except sinks.VersionTaken as error:
            failed.append(error)
        return real(df, path, file_type)

    monkeypatch.setattr(sinks, "save_new", second_writer)
    path = sinks.replace_version(spark.range(3), root, "d", pointers)
    assert len(failed) == 1 and sinks.current_path(spark, pointers, "d") == path and spark.read.parquet(path).count() == 3
    # A job that died after its claim is passed over once it is given up.
    sinks._claim(spark, f"{root}/d", sinks._pointer(spark, pointers, "d"))
    with pytest.raises(sinks.VersionTaken):
        sinks.replace_version(spark.range(4), root, "d", pointers)
    sinks.abandon(spark, root, "d", pointers)
    assert sinks.replace_version(spark.range(4), root, "d", pointers).endswith("v000003/data")


def test_csv_with_schema_and_json_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id;price\n1;2.5\n2;bad\n3;1;9\n")
    rows = readers.read_csv(spark, str(path), ";", "id int, price double").collect()
    assert [(r["id"], r["price"]) for r in rows] == [(1, 2.5), (2, None)]
    lines = tmp_path / "l.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_table(spark, str(lines)).count() == 2


def test_json_array_and_unknown_type(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert readers.read_table(spark, str(path)).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "t.xlsx")


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "01_a.md").write_text("---\ntags: metric, group\n---\n\nBody text\n")
    (tmp_path / "02_b.md").write_text("No header\n")
    rows = {r["chunk_id"]: r for r in readers.read_knowledge(spark, str(tmp_path)).collect()}
    assert rows["01_a"]["tags"] == "metric, group" and rows["01_a"]["text"] == "Body text"
    assert rows["02_b"]["tags"] == "" and rows["02_b"]["text"] == "No header"


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_save_new_never_overwrites(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    path = sinks.save_new(df, sinks.cleaned_name(str(tmp_path / "t")), kind)
    assert path.endswith("cleaned_t")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.save_new(df, path, kind)


def test_versions_and_log(spark, tmp_path):
    root, pointers = str(tmp_path / "data"), str(tmp_path / "pointers")
    assert sinks.current_path(spark, pointers, "d") is None
    first = sinks.replace_version(spark.range(3), root, "d", pointers)
    # The new version is computed from the one it replaces.
    second = sinks.replace_version(spark.read.parquet(first).filter("id > 0"), root, "d", pointers)
    assert sinks.current_path(spark, pointers, "d") == second != first
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 2
    log = str(tmp_path / "log")
    for n in (1, 2):
        sinks.append_log(spark, log, [("d", "p", 3, 2, 1, 0, 0, 0, json.dumps({"run": n}))])
    assert spark.read.parquet(log).count() == 2


def test_folder_ingest_is_replayable(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = "id long, value double, label string"
    rows = [(i, None if i == 2 else float(i), "NA" if i == 1 else "x") for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    fields = spark.createDataFrame([], schema).schema
    run = lambda: ingest_folder(spark, str(source), fields, str(target), "id").awaitTermination(180)
    run()
    spark.createDataFrame([(11, 1.0, "y")], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()
    assert read_stage(spark, str(target), "rows").count() == 11
    issues = {(r["row_key"], r["issue_type"]) for r in read_stage(spark, str(target), "issues").collect()}
    assert {(2, "missing"), (1, "missing_token")} <= issues
    status = manifest(spark, str(target))
    assert status.filter("status <> 'done'").count() == 0 and status.select("batch").distinct().count() == 2
    # A batch run again takes the place of its first run; what a failed attempt leaves behind is not read.
    run_stages(spark.createDataFrame([(11, 1.0, "y")], schema), 1, str(target), default_stages("id"))
    broken = {"rows": lambda df: df.withColumn("value", F.raise_error(F.lit("no")).cast("double"))}
    with pytest.raises(Exception, match="no"):
        run_stages(spark.createDataFrame([(12, 1.0, "y")], schema), 1, str(target), broken)
    assert sorted(r["id"] for r in read_stage(spark, str(target), "rows").collect()) == [*range(10), 11]
    assert read_stage(spark, str(target), "profile").count() == 6


def test_one_stage_may_fail(spark, tmp_path):
    def broken(df):
        raise RuntimeError("no")

    status = run_stages(spark.range(2), 0, str(tmp_path), {"rows": lambda d: d, "broken": broken})
    assert status["rows"] == "done" and status["broken"].startswith("failed: RuntimeError")


def talk(spark):
    rows = [("hot", i, "user" if i % 5 in (0, 1, 3) else "assistant", f" text {i} ") for i in range(60)]
    rows += [("b", 0, "user", ""), ("b", 1, "user", "x" * 700), ("b", 2, "assistant", "line\none")]
    return spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), rows


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_merge_turns(spark, scale):
    df, rows = talk(spark)
    got = {(r["conv_id"], r["first_turn"]): (r["role"], r["text"]) for r in turns.merge_turns(df, scale=scale).collect()}
    want, last = {}, None
    for conv, turn, role, body in rows:
        body = body.strip() or "(empty message)"
        if last and last[0] == conv and last[2] == role:
            want[last[:2]] = (role, want[last[:2]][1] + "\n\n" + body)
        else:
            last = (conv, turn, role)
            want[last[:2]] = (role, body)
    assert got == want


@pytest.mark.parametrize("scale, block", [(Scale(), 10_000), (TINY, 10)])
def test_contextual_query(spark, scale, block):
    df, rows = talk(spark)
    got = {(r["conv_id"], r["turn"]): r["query"] for r in turns.contextual_query(df, block_turns=block, scale=scale).collect()}
    for i, (conv, turn, role, body) in enumerate(rows):
        if role != "user":
            assert (conv, turn) not in got
            continue
        history = [(r, t.strip().replace("\n", " ")) for c, k, r, t in rows if c == conv and turn - 8 <= k < turn]
        message = body.strip()
        lines = [f"{r}: {t if len(t) <= 320 else t[:320] + '…'}" for r, t in history]
        assert got[(conv, turn)] == (message if len(message) >= 100 or not history else "\n".join([*lines, f"user: {message}"]))


def test_transcript_tail_shortens(spark):
    df, _ = talk(spark)
    tail = {r["conv_id"]: r["transcript"] for r in turns.transcript_tail(df, 2).collect()}
    assert tail["b"] == f"user: {'x' * 600}…\nassistant: line one"


@pytest.mark.parametrize("scale", [Scale(), TINY])
def test_last_question(spark, scale):
    rows = [("a", 0, "user", "how much did we sell in march"), ("a", 1, "assistant", "a lot"), ("a", 2, "user", "show a chart"), ("a", 3, "user", "hi"), ("a", 4, "user", "plot it")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["turn"]: r["question"] for r in turns.last_question(df, scale=scale).collect()}
    assert got == {0: rows[0][3], 2: rows[0][3], 3: "hi", 4: rows[0][3]}


def test_empty_query_keeps_order(spark):
    df = spark.createDataFrame([(i, f"word{i}") for i in range(5)], "id int, text string")
    assert [r["id"] for r in retrieval.lexical_topk(df, "text", "", "id", 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in retrieval.lexical_topk(df, "text", "WORD3, word1!", "id", 3).collect()] == [1, 3, 0]


def test_chunks_of_one_dataset(spark):
    profile = spark.createDataFrame([("a", "int", 0.0, 3)], "column string, dtype string, missing_pct double, unique long")
    found = spark.createDataFrame([(f"a{i}", "b", "correlation", i / 100, "d", "m", "i") for i in range(60)], "col_a string, col_b string, type string, strength double, direction string, method string, insight string")
    made = retrieval.build_chunks(profile, "5", profile, found, "a", {"metrics": ["a"]}, str(datetime.date(2024, 1, 1)), ["cite facts only"])
    kinds = {r["chunk_type"]: r["count"] for r in made.groupBy("chunk_type").count().collect()}
    assert kinds == {"column_fact": 1, "relationship": 60, "metric_definition": 1, "guardrail": 1}
    assert made.select(F.countDistinct("chunk_id")).first()[0] == 63
