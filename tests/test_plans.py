"""Retrieval, chunks, graphs, rounds and tables on small rows made by hand, against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell import storage
from sparkwell.functions import text as T
from sparkwell.operators import chunking, embedding, fusion, graph, ingest, metrics, policy, retrieval
from sparkwell.plans import evaluation, hybrid, rounds
from sparkwell.sources import files
from sparkwell.streaming.ingest import session_stream

DOCS = [(1, "red fox jumps"), (2, "red red dog"), (3, None), (4, ""), (5, "blue fox"), (5, "blue fox")]


def bm25(docs, query):
    texts = [re.findall(r"\w+", (t or "").lower()) for _, t in docs]
    mean = sum(map(len, texts)) / len(texts)
    out = []
    for (i, _), words in zip(docs, texts):
        s = 0.0
        for t in set(re.findall(r"\w+", (query or "").lower())):
            df, tf = sum(t in w for w in texts), words.count(t)
            s += np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if s > 0:
            out.append((round(-s, 9), i))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 100])
def test_bm25_against_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3)
    asked = [("a", "the red fox"), ("b", None), ("c", "Blue"), ("d", "nothing here")]
    q = spark.createDataFrame(asked, "query_id string, text string")
    got = {}
    for r in retrieval.bm25_top_k(q, docs, "doc_id", "text", 3, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(-r.score, 9), r.id))
    for name, text in asked:
        want = bm25(DOCS, text)[:3]
        assert [(s, i) for _, s, i in sorted(got.get(name, []))] == [(pytest.approx(s), i) for s, i in want]
    assert [r.id for r in retrieval.bm25_top_k(q, docs, "doc_id", "text", 9, every=True).where("query_id = 'a'").collect()] == []
    assert retrieval.bm25_top_k(q.limit(0), docs, "doc_id", "text", 3).count() == 0 == retrieval.bm25_top_k(q, docs.limit(0), "doc_id", "text", 3).count()


def test_ids_of_any_kind_and_ties(spark):
    docs = spark.createDataFrame([((2, 1), "x"), ((1, 9), "x"), ((None, 3), "x"), ((1, 2), "x")], "id struct<a:int,b:int>, text string").repartition(4)
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    rows = retrieval.bm25_top_k(q, docs, "id", "text", 3).orderBy("rank").collect()
    assert [tuple(r.id) for r in rows] == [(None, 3), (1, 2), (1, 9)]
    named = docs.select(F.concat_ws("-", "id.a", "id.b").alias("id"), "text")
    assert [r.id for r in retrieval.bm25_top_k(q, named, "id", "text", 2).orderBy("rank").collect()] == ["1-2", "1-9"]


def test_odd_vectors_score_one(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [2.0, 2.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.id): r.score for r in retrieval.cosine_top_k(q, v, 9).collect()}
    assert got[7, 1] == pytest.approx(2) and got[7, 5] == pytest.approx(1 + 0.5**0.5)
    assert all(got[k] == 1 for k in [(7, 2), (7, 3), (7, 4), (8, 1), (8, 2)])


def test_multiset_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"], ["a", "c", "a", "b", "b"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.multiset_overlap(F.col("a"), F.col("b"))).collect()] == [3, 0]


def test_hashed_vectors(spark):
    import hashlib

    df = spark.createDataFrame([("a b a",), (None,), ("",)], "t string")
    rows = [r[0] for r in df.select(embedding.hashed_vector(F.col("t"))).collect()]
    want = np.zeros(64)
    for w in "aba":
        want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
    assert rows[0] == want.tolist() and sum(rows[1]) == sum(rows[2]) == 0


def test_pair_ratio_by_hand(spark):
    rows = spark.createDataFrame([(1, i, [1.0, 0.0], e) for i, e in enumerate([[1.0, 0.0], [1.0, 0.1], [1.0, 1.0], [0.2, 1.0]])] + [(2, 1, [1.0], [1.0])], "query_id int, id int, query array<double>, embedding array<double>")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    e = [np.array(x) for x in ([1.0, 0.0], [1.0, 0.1], [1.0, 1.0], [0.2, 1.0])]
    w = sorted((cos(e[i], e[j]) * cos(e[i], e[0]) * cos(e[j], e[0]) for i in range(4) for j in range(i)), reverse=True)
    got = {r.query_id: r.ratio for r in policy.pair_ratio(rows).collect()}
    assert got[1] == pytest.approx(np.mean(w[:3]) / np.mean(w[-3:])) and got[2] is None


def test_list_routes_and_weights(spark):
    df = spark.createDataFrame([("what is it",), ("in 1999",), ("the NASA thing that went up to the moon",), ("one two three four five six seven",)], "q string")
    w = [tuple(r) for r in df.select(*fusion.list_weights(F.col("q"))).collect()]
    assert w == [(2.0, 1.0), (1.0, 3.0), (1.0, 3.0), (1.0, 1.0)]


def test_parts_of_a_query(spark):
    asked = ["Did both the red fox and the blue dog run far?", "What came before the great old war?", "plain", "a b c or d e f?"]
    rows = [r[0] for r in spark.createDataFrame([(x,) for x in asked], "q string").select(hybrid.parts_of(F.col("q"))).collect()]
    assert rows[0] == [asked[0], "Did both the red fox", "the blue dog run far"]
    assert rows[1] == [asked[1], "the great old war"] and rows[2] == ["plain"] and rows[3] == [asked[3], "a b c", "d e f"]


def test_clause_gate(spark):
    votes = spark.createDataFrame([(1, "SUPPORTED"), (1, "SUPPORTED"), (1, "x"), (2, "CONTRADICTED"), (3, "SUPPORTED"), (3, "CONTRADICTED"), (4, "?")], "id int, verdict string")
    got = {r.id: (r.aggregate, r.kept) for r in hybrid.clause_gate(votes, ["id"]).collect()}
    assert got == {1: ("SUPPORTED", True), 2: ("CONTRADICTED", False), 3: ("MIXED", False), 4: ("INSUFFICIENT", False)}


def test_nothing_selected_keeps_the_head(spark):
    rows = spark.createDataFrame([(1, "zzz", i, "", 1.0, i) for i in (1, 2, 3)], "query_id int, query string, id int, text string, score double, rank int")
    assert [r.id for r in hybrid.selected(rows, 2).orderBy("place").collect()] == [1, 2]


def test_units_are_packed(spark):
    text = "aaa\nbbb\n\n" + "c" * 13 + "\n\ndd\nee"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = [r[0] for r in df.select(chunking.unit_chunks(F.col("t"), 8, 2)).collect()]
    assert rows[0] == ["aaa\nbbb", "c" * 8, "c" * 7, "c", "dd\nee"] and not rows[1] and not rows[2]
    got = spark.createDataFrame([("One. Two. Three four five.",)], "t string").select(chunking.sentence_chunks(F.col("t"), 10, 2)).first()[0]
    assert [(x.text, x.sentence_texts) for x in got][:1] == [("One. Two.", ["One.", "Two."])]


def test_serialised_groups():
    assert chunking.serialised("T", ["a", "b", "c", "d", "e"]) == ["TITLE: T\nPARAGRAPH_STRUCTURE:\nSENTENCE_0: a\nSENTENCE_1: b\nSENTENCE_2: c\nSENTENCE_3: d", "TITLE: T\nPARAGRAPH_STRUCTURE:\nSENTENCE_4: e"]
    long = chunking.serialised("T", ["x" * 600, "y" * 300, "z" * 200], 512)
    assert [x.count("SENTENCE_") for x in long] == [1, 2] and "x" * 257 not in long[0] and "x" * 256 in long[0]


def test_request_batches(spark):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 5, 30, 1, 1, 1, 1])], "id int, t string").coalesce(1)
    got = [(r.ids, r.n_chars) for r in chunking.request_batches(rows, "id", "t", 3, 20).collect()]
    assert got == [([0, 1], 10), ([2], 30), ([3, 4, 5], 3), ([6], 1)]


def test_windows_of_wide_characters(spark):
    text = "🙂é" * 400
    got = spark.createDataFrame([(text,)], "t string").select(T.windows(F.col("t"))).first()[0]
    assert got == [text[a : a + 512] for a in range(0, len(text), 448)]


def test_walks_equal_dense_algebra(spark):
    links = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")]
    seeds = [(1, "a", 1.0), (1, "x", 0.25), (2, "c", 2.0), (2, "b", 2.0)]
    got = {(r.query_id, r.node): r["rank"] for r in graph.walks(spark.createDataFrame(seeds, "query_id int, node string, weight double"), spark.createDataFrame(links, "a string, b string")).collect()}
    nodes = sorted({n for e in links for n in e})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes),) * 2)
    for a, b in links:
        m[at[b], at[a]] = m[at[a], at[b]] = 1
    m /= m.sum(0)
    for q in (1, 2):
        base = np.zeros(len(nodes))
        for k, n, w in seeds:
            if k == q:
                base[at[n]] += w
        base /= base.sum()
        r = base
        for _ in range(50):
            r = 0.85 * m @ r + 0.15 * base
        assert {n: got.get((q, n), 0.0) for n in nodes} == pytest.approx(dict(zip(nodes, r)), abs=1e-5)


def test_entities_normalise(spark):
    df = spark.createDataFrame([("The Red Fox", "A Red Fox met O'Neil Corp. in Rome and the old Rome"), (None, None)], "source string, text string")
    rows = [[(e.entity, e.name) for e in r[0]] for r in df.select(graph.entities(F.col("source"), F.col("text"))).collect()]
    assert rows[0][0] == ("red fox", "The Red Fox") and ("rome", "Rome") in rows[0] and rows[1] == []


def test_rounds_stop_and_read(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "delta")], "id int, text string")
    find = lambda asked: retrieval.bm25_top_k(asked, texts, "id", "text", 2).join(texts, "id").select("query_id", "id", "text", "rank")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "delta epsilon zeta"), (3, "")], "query_id int, text string")
    out = rounds.in_rounds(q, find, rounds.Terms())
    at = {(r.query_id, r.round) for r in out.select("query_id", "round").collect()}
    assert (1, 0) in at and (1, 1) not in at and (3, 0) not in at
    assert all(r.place <= 2 for r in rounds.final_contexts(out, 1).collect())


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert storage.ensure_table(spark, path, "id long, hash_id string") and not storage.ensure_table(spark, path, "id long, hash_id string", ("hash_id",))
    assert ingest.insert(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, hash_id string"), path) == 2
    assert storage.count_where(spark, path, "hash_id = 'b'") == 1
    storage.check_ready(spark.read.parquet(path))
    with pytest.raises(ValueError):
        storage.check_ready(spark.createDataFrame([(1, None)], "id long, hash_id string"))
    files.upsert_into(spark.createDataFrame([(9, "b")], "id long, hash_id string"), path, "hash_id", "id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect() if r.hash_id == "b") == [(9, "b")]
    assert storage.ensure_table(spark, path, "id long, hash_id string, v string", ("v",)) and storage.count_where(spark, path) == 0


def test_backfill_is_applied(spark):
    rows = spark.createDataFrame([(1, "k", "x", None), (2, "k", "x", None), (3, "k", " ", None), (4, "k", "y", "old")], "id int, key string, text string, old string")
    plan = ingest.backfill_plan(rows, F.col("key"), "text", "old", ["id"])
    out = {r.id: r.old for r in ingest.apply_backfill(plan, "old").collect()}
    assert set(out) == {1, 3, 4} and out[3] is None and len(out[1]) == len(out[4]) == 64


def test_export_and_find(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = spark.createDataFrame([("a/b", "x" * 200), ("c", "short"), (None, None)], "name string, text string")
    first = {r.name: r.written for r in files.export_texts(rows, folder, "name", "text").collect()}
    assert first == {"a_b.txt": True, "c.txt": True, ".txt": True}
    assert not any(r.written for r in files.export_texts(rows, folder, "name", "text").collect())
    found = storage.find_data(spark, f"file://{folder}", "none.json", "*.txt")
    assert [x.rsplit("/", 1)[1] for x in found] == ["a_b.txt"]
    assert storage.find_data(spark, f"file://{folder}", "c.txt", "*.txt") == [f"file://{folder}/c.txt"]


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in files.csv_table(spark, f"file://{tmp_path}/x.csv").collect()] == [(1, "x"), (2, None)]
    files.write_json_lines(spark.createDataFrame([(1, "é")], "a int, b string"), f"file://{tmp_path}/j")
    assert [tuple(r) for r in files.json_lines(spark, f"file://{tmp_path}/j", "a int, b string").collect()] == [(1, "é")]


def test_sessions_append_once(spark, tmp_path):
    spark.createDataFrame([("s", 1, "user", "hi"), ("s", 2, "assistant", "yes")], "conv_id string, turn int, role string, text string").write.parquet(f"file://{tmp_path}/in")
    for n in ("c1", "c2"):
        stream = spark.readStream.schema("conv_id string, turn int, role string, text string").parquet(f"file://{tmp_path}/in")
        session_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/{n}").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_vectors_by_cache(spark):
    cache = spark.createDataFrame([(None, [9.0])], "hash string, embedding array<double>").limit(0)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, text string")
    out, fresh = ingest.with_vectors(rows, cache, embedding.hashed_vector)
    assert fresh.count() == 1 and {r.id: r.embedding is not None for r in out.collect()} == {1: True, 2: True, 3: False}


def test_reports(spark):
    gold = spark.createDataFrame([(1,), (2,)], "id int")
    got = evaluation.corpus_means(gold, spark.createDataFrame([(1, 1.0)], "id int, em double"), ["id"], ["em"]).first()
    assert (got.n, got.em) == (2, 0.5)
    df = spark.createDataFrame([("Paris is big", "paris"), ("", "x"), ("the", "")], "s string, p string")
    assert [r[0] for r in df.select(metrics.extractiveness(F.col("s"), F.col("p"))).collect()] == [1.0, 0.0, 1.0]


@pytest.mark.parametrize("block, part", [(256, 2048), (2, 3)])
def test_best_walked_equals_walks(spark, block, part):
    """The documents that walks visit most, whatever the blocks of queries and the parts of documents are; rows of a node aren't joined link by link."""
    rnd = np.random.default_rng(9)
    links = [(int(d), f"n{e}") for d in range(14) for e in rnd.choice(9, 3, replace=False)] + [(20, "alone"), (20, "alone")]
    seeds = [(q, f"n{q}", None, 1.0) for q in range(5)] + [(q, None, str(d), 0.25) for q in range(5) for d in (q, q + 3)] + [(7, "alone", None, 1.0)]
    m = spark.createDataFrame(links, "doc_id long, entity string")
    s = spark.createDataFrame(seeds, "query_id int, entity string, doc_id string, weight double")
    entity, doc = F.concat(F.lit("e:"), "entity"), F.concat(F.lit("d:"), F.col("doc_id").cast("string"))
    slow = graph.walks(s.select("query_id", F.coalesce(entity, doc).alias("node"), "weight"), m.select(entity.alias("a"), doc.alias("b")), rounds=10).where("node like 'd:%'")
    want = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.top_k(slow.select("query_id", F.expr("substr(node, 3)").alias("id"), F.col("rank").alias("score")), 2).collect()}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in graph.best_walked(s, m, 2, rounds=10, block=block, part=part).collect()}
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert [got[x][1] for x in sorted(got)] == pytest.approx([want[x][1] for x in sorted(got)], abs=1e-9)


def test_walks_shuffle_as_much_whatever_the_rounds(spark, monkeypatch):
    """The graph is dealt to blocks of queries once; no round of a walk is a shuffle or writes a table."""
    made, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(name) or write(df, name))
    m = spark.createDataFrame([(d, f"n{(d + e) % 5}") for d in range(6) for e in range(2)], "doc_id long, entity string")
    s = spark.createDataFrame([(q, f"n{q}", None, 1.0) for q in range(3)], "query_id int, entity string, doc_id string, weight double")
    seen = []
    for n in (2, 30):
        made.clear()
        plan = graph.best_walked(s, m, 2, rounds=n, block=2)._jdf.queryExecution().executedPlan().toString()
        seen.append((plan.count("Exchange "), sorted(made)))
    assert seen[0] == seen[1] and len(seen[0][1]) < 8


def test_lists_of_sub_queries_are_found_once(spark, data):
    """The fused lists come from written hits, not from a search for each part of a question."""
    from sparkwell.catalogue import QUERIES

    plan = QUERIES["hybrid_subqueries"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan
