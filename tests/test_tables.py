"""Versioned tables, readers and sinks, sessions as state, and chunkers as table functions."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkwell import storage
from sparkwell.functions import tables
from sparkwell.operators import chunking, fusion, ingest, variants
from sparkwell.functions import text as T
from sparkwell.sources import files, predictions
from sparkwell.sources.zipped import ZippedLines
from sparkwell.streaming.ingest import session_stream
from sparkwell.streaming.sessions import state_stream
from sparkwell.versions import Conflict, Table

KV = "k string, v int, o int"


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), KV)


def seen(df):
    return sorted((str(r.k), r.v) for r in df.collect())


def test_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    assert not t.exists() and t.ensure(KV) and not t.ensure(KV, ("v",)) and t.read().count() == 0
    t.append(kv(spark, ("a", 1, 1)))
    assert t.insert(kv(spark, ("a", 9, 9), ("b", 2, 1), ("b", 2, 1), (None, 3, 1)), "k") == 2
    assert t.insert(kv(spark, ("b", 7, 7), (None, 4, 1)), "k") == 0
    t.upsert(kv(spark, ("a", 5, 1), ("a", 6, 2), (None, 8, 1)), "k", "o")
    assert seen(t.read()) == [("None", 8), ("a", 6), ("b", 2)]
    assert seen(t.read(2)) == [("a", 1)]
    t.replace(t.read().where("k = 'b'"))  # reads what it replaces
    assert seen(t.read()) == [("b", 2)] and [v.what for v in t.history()] == ["reset", "append", "insert", "insert", "upsert", "replace"]
    t.restore(2)
    assert seen(t.read()) == [("a", 1)]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "other int"))
    assert t.ensure(KV + ", more string", ("more",)) and t.read().columns[-1] == "more"
    assert t.vacuum(2) > 0 and t.read().count() == 0
    with pytest.raises(ValueError):
        t.version(1)


def test_batches_count_once(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        t.append(kv(spark, ("a", 1, 1)), batch=("s", 0))
    t.insert(kv(spark, ("b", 1, 1)), "k", batch=("s", 1))
    assert t.insert(kv(spark, ("c", 1, 1)), "k", batch=("s", 1)) == 0
    assert seen(t.read()) == [("a", 1), ("b", 1)]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.append(kv(spark, ("a", 1, 1)))

    class Died(Exception):
        pass

    def die(new):
        raise Died

    for change in (lambda x: x.append(kv(spark, ("b", 1, 1))), lambda x: x.replace(kv(spark, ("b", 1, 1))), lambda x: x.upsert(kv(spark, ("a", 7, 1)), "k", "o"), lambda x: x.insert(kv(spark, ("b", 1, 1)), "k")):
        dying = Table(spark, t.path)
        dying.commit = die
        with pytest.raises(Died):
            change(dying)
        assert seen(t.read()) == [("a", 1)] and t.version().number == 1
    t.append(kv(spark, ("c", 1, 1)))
    assert seen(t.read()) == [("a", 1), ("c", 1)] and t.vacuum(1) >= 4 and seen(t.read()) == [("a", 1), ("c", 1)]


def test_one_of_two_writers_wins(spark, tmp_path):
    """Another writer commits between a writer's reading and its commit: appends, inserts and upserts begin again, a replacement says so."""
    t = Table(spark, f"file://{tmp_path}/t")
    t.append(kv(spark, ("a", 1, 1)))

    def overtaken(by):
        other, real = Table(spark, t.path), Table(spark, t.path)
        commit, rows = real.commit, [by]

        def first_another(new):
            if rows:
                other.append(kv(spark, rows.pop()))
            return commit(new)

        real.commit = first_another
        return real

    overtaken(("x", 1, 1)).append(kv(spark, ("b", 1, 1)))
    assert overtaken(("c", 1, 1)).insert(kv(spark, ("c", 9, 9), ("d", 1, 1)), "k") == 1
    overtaken(("y", 1, 1)).upsert(kv(spark, ("a", 5, 1)), "k", "o")
    assert seen(t.read()) == [("a", 5), ("b", 1), ("c", 1), ("d", 1), ("x", 1), ("y", 1)]
    with pytest.raises(Conflict):
        overtaken(("z", 1, 1)).replace(kv(spark, ("lost", 1, 1)))
    assert ("z", 1) in seen(t.read()) and ("lost", 1) not in seen(t.read())


def test_replacing_survives_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    kv(spark, ("a", 1, 1)).write.parquet(path)
    storage.replace_table(spark.read.parquet(path).withColumn("v", F.lit(2)), path)
    assert seen(spark.read.parquet(path)) == [("a", 2)] and not os.path.exists(f"{tmp_path}/t.aside")
    os.rename(f"{tmp_path}/t", f"{tmp_path}/t.aside")  # it died between the two moves
    assert storage.recover(spark, path) and seen(spark.read.parquet(path)) == [("a", 2)] and not storage.recover(spark, path)


def test_null_ids_keep_their_chunks(spark):
    docs = spark.createDataFrame([(None, "first text"), (None, "second text"), (None, "first text"), (1, "first text")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.chunk) for r in ingest.hashed_chunks(docs).collect()) == [("1", "first text"), ("None", "first text"), ("None", "second text")]


def test_json_lines_whatever_is_read(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "zz", "b": "y"}\n{"a": 1, "b": "z"}\n\n  \nnot json\n[1]\n7\n{"b": "only"}\n{"a": null, "b": null}\n')
    rows = files.json_lines(spark, f"file://{tmp_path}/x.jsonl", "a long, b string")
    want = [(None, None), (None, "only"), (1, "z")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
    assert rows.count() == rows.select("b").count() == len(rows.select("b").collect()) == len(rows.select("a").collect()) == 3


def test_titles_of_odd_names(spark, tmp_path):
    for name in ("c++_notes.txt", "50%_off.txt", "a b-é.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.title for r in files.text_files(spark, f"file://{tmp_path}/*.txt").collect()) == ["50% Off", "A B É", "C++ Notes"]


def test_scripts_leave_nothing(spark):
    html = "foo<script>x</script>bar <style type=a>b</style>baz<b>q</b>&amp;"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_text(F.col("h"))).first()[0] == "foobar baz q &amp;"


def test_sessions_tell_nulls_apart(spark, tmp_path):
    rows = [(None, "1", "user", "a"), ("1", None, "user", "b"), ("1:2", "3", "user", "c"), ("1", "2:3", "user", "d"), (None, None, "user", "e")]
    schema = "conv_id string, turn string, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    session_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list("abcde")


def test_an_id_twice_in_a_list_counts_once(spark):
    schema = "query_id int, id int, rank int, score double"
    a = spark.createDataFrame([(1, 1, 1, 3.0), (1, 1, 2, 3.0), (1, 2, 3, 1.0)], schema)
    got = {r.id: r.rrf for r in fusion.rrf([(a, 1.0)], 5).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 63})


@pytest.mark.parametrize("part", [7, 64, 1 << 20])
def test_zipped_lines_in_parts(spark, tmp_path, part):
    rnd = random.Random(part)
    members = {}
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for name, how in (("stored.jsonl", zipfile.ZIP_STORED), ("packed.jsonl", zipfile.ZIP_DEFLATED), ("sub/empty.jsonl", zipfile.ZIP_STORED), ("skip.txt", zipfile.ZIP_STORED)):
                text = "" if "empty" in name else "\n".join("é" * rnd.randint(0, 30) + str(i) for i in range(50)) + rnd.choice(["", "\n"])
                z.writestr(name, text, how)
                members[f"{k}.zip", name] = text
    spark.dataSource.register(ZippedLines)
    df = spark.read.format("zipped_lines").option("members", "*.jsonl").option("part", part).load(str(tmp_path))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.member, r.part, r.line_no)):
        got.setdefault((os.path.basename(r.path), r.member), []).append(r.line)
    for key, text in members.items():
        want = [] if key[1] == "skip.txt" else text.removesuffix("\n").split("\n") if text else []
        assert got.get(key, []) == want, key
    if part == 7:
        assert df.select("path", "member", "part").where("member = 'stored.jsonl'").distinct().count() > 20
    assert spark.read.format("zipped_lines").load(f"{tmp_path}/0.zip").where("member = 'skip.txt'").count() == 50


def test_predictions_as_one_document(spark, tmp_path):
    rows = [(f"q{i}", f'an "odd" \\ answer {i}\né', [["Title", str(i)], ["T2", "0"]] if i % 3 else None) for i in range(50)] + [(None, "x", None), ("q1", "later", None)]
    frame = spark.createDataFrame(rows, "query_id string, answer string, facts array<array<string>>").repartition(4)
    path = f"file://{tmp_path}/p.json"
    for _ in range(2):  # the second takes the first one's place
        predictions.write_answers(frame.where("answer <> 'later'"), path)
    got = json.loads((tmp_path / "p.json").read_text())
    assert got["answer"] == {r[0]: r[1] for r in rows if r[0] and r[1] != "later"}
    assert got["sp"] == {r[0]: r[2] for r in rows if r[0] and r[1] != "later"}
    assert not [x for x in os.listdir(tmp_path) if x not in ("p.json", ".p.json.crc")]
    back = predictions.read_answers(spark, path, "array<array<string>>").collect()
    assert {r.id: r.answer for r in back} == got["answer"] and len(back) == 50
    predictions.write_report(frame, f"file://{tmp_path}/r.json", ("query_id", "answer"), model="m", accuracy=0.5)
    report = json.loads((tmp_path / "r.json").read_text())
    assert (report["model"], report["accuracy"]) == ("m", 0.5) and [p["query_id"] for p in report["predictions"]] == [r[0] for r in sorted(rows, key=lambda r: (r[0] or "", r[1]))]
    predictions.write_answers(frame.limit(0), path)
    assert json.loads((tmp_path / "p.json").read_text()) == {"answer": {}, "sp": {}}


def test_a_failed_document_leaves_the_old_one(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1")], "query_id string, answer string")
    path = f"file://{tmp_path}/p.json"
    predictions.write_document(spark, {"answer": predictions.Object(frame, "query_id", "answer")}, path)
    bad = frame.withColumn("answer", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        predictions.write_document(spark, {"answer": predictions.Object(bad, "query_id", "answer")}, path)
    assert json.loads((tmp_path / "p.json").read_text()) == {"answer": {"a": "1"}} and len([x for x in os.listdir(tmp_path) if not x.startswith(".")]) == 1


def test_sessions_as_state(spark, tmp_path):
    """Messages in three batches, some of them twice, with a restart in between, equal one pass over all."""
    schema = "conv_id string, turn long, role string, text string"
    rows = [(s, t, "user" if t % 2 == 0 else "assistant", f"{s}{t}") for s in ("a", "b", None) for t in range(6)]
    batches = [rows[:7], rows[4:12], rows[10:] + rows[:3]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        state_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.session, r.turn, r.text) for r in got) == sorted(("-" if s is None else f"={s}", t, x) for s, t, _, x in rows)
    for s in {r.session for r in got}:
        own = [r for r in got if r.session == s]
        assert sorted(r.number for r in own) == list(range(1, 7)) and all(r.n_messages == r.number for r in own)


def test_table_functions_equal_columns(spark, data):
    names = tables.register(spark, {"lines": lambda text: text.splitlines()})
    assert set(names) == {"chunks", "chunk_windows", "chunk_sentences", "chunk_units", "chunk_structure", "chunk_lines"}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\n "), (-4, "a\r\nb\r\n\r\nc d. E f! " + "x" * 1300 + ". End"), (-5, "Ünïcode. Zwei\nDrei")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    docs.createOrReplaceTempView("chunked_docs")
    text = F.col("text")
    columns = {
        "windows": T.windows(text),
        "sentences": F.transform(chunking.sentence_chunks(text), lambda x: x["text"]),
        "units": chunking.unit_chunks(text),
        "structure": variants.packed(variants.structure_units(text), 512),
    }
    for name, column in columns.items():
        want = sorted(map(tuple, docs.select("doc_id", F.posexplode(column)).collect()))
        assert want == sorted(map(tuple, spark.sql(f"SELECT doc_id, chunk_index, chunk FROM chunked_docs, LATERAL chunk_{name}(text)").collect())), name
        assert len(want) == spark.sql(f"SELECT * FROM chunked_docs, LATERAL chunks('{name}', text)").count()
    assert spark.sql("SELECT chunk FROM chunks('lines', 'a\\nb')").count() == 2
    with pytest.raises(Exception, match="no strategy"):
        spark.sql("SELECT * FROM chunks('none', 'a')").collect()
