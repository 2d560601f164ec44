import zipfile

from sparkwell.operators.ingest import hashed_chunks
from sparkwell.sources import files
from sparkwell.streaming.ingest import ingest_stream


def test_text_files(spark, tmp_path):
    (tmp_path / "big_red-cat.txt").write_text("one\ntwo")
    r = files.text_files(spark, f"file://{tmp_path}/*.txt").first()
    assert (r.title, r.text) == ("Big Red Cat", "one\ntwo")


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert files.json_array(spark, f"file://{tmp_path}/a.json", "id int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 3}\n')
    assert sorted(r.id for r in files.json_lines(spark, f"file://{tmp_path}/b.jsonl", "id int").collect()) == [1, 3]


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.jsonl", "a\nb\nc\n")
    got = files.zipped_lines(spark, f"file://{tmp_path}/c.zip", 2).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(2, "b"), (3, "c")]


def test_qrels(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\nq\td\t2\nshort\n")
    assert [tuple(r) for r in files.qrels(spark, f"file://{tmp_path}/q.tsv").collect()] == [("q", "d", 2)]


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, o int, v int").write.parquet(path)
    new = spark.createDataFrame([("a", 0, 5), ("a", 2, 6)], "k string, o int, v int")
    assert {r.k: r.v for r in files.upsert(new, path, "k", "o").collect()} == {"a": 6, "b": 1}


def test_stream_equals_batch(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for check in ("c1", "c2"):  # the second run sends everything again
        ingest_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/{check}").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").select("hash_id").toPandas().hash_id
    want = hashed_chunks(docs).select("hash_id").toPandas().hash_id
    assert sorted(got) == sorted(want)
