"""Edge cases of the operators on small rows made by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators import fusion, graph, ingest, metrics, policy, retrieval, variants


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'double' if isinstance(values[n], float) else 'string'}" for n in names))
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("n,want", [(448, 1), (449, 2), (512, 2), (513, 2), (0, 0)])
def test_windows(spark, n, want):
    text = "x" * n
    got = one(spark, T.windows(F.col("t")), t=text) or []
    assert got == [text[a : a + 512] for a in range(0, n, 448)] and len(got) == want


def test_windows_of_blank_and_null(spark):
    assert one(spark, T.windows(F.col("t")), t="  \n ") == []
    assert one(spark, T.windows(F.col("t")), t=None) is None
    with pytest.raises(ValueError):
        T.windows(F.lit("x"), 64, 64)


def test_chunk_hash_keeps_the_first(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert ingest.hashed_chunks(docs).count() == 2
    twice = spark.createDataFrame([(1, "x" * 448 + "x" * 448 + "x" * 100)], "doc_id long, text string")
    rows = ingest.hashed_chunks(twice).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 2]  # the first two windows are equal


def test_document_key(spark):
    f = F.col
    key = ingest.document_key(f("i"), f("c"), f("s"), f("t"), f("z"))
    assert one(spark, key, i="", c="c", s="s", t="t", z="z") == "c:s"
    assert one(spark, key, i="d", c="c", s="s", t="t", z="z") == "d"
    assert one(spark, key, i=None, c="c", s="", t="t", z="z") == "c:t"


def test_reserved_columns():
    with pytest.raises(ValueError):
        ingest.check_columns(["title", "embedding"])


def test_insert_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "hash_id string, v int")
    path = f"file://{tmp_path}/t"
    assert ingest.insert(new, path) == 2
    assert ingest.insert(new, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_normalisation_orders_differ(spark):
    assert one(spark, T.normalize_answer(F.col("t")), t="a.b") == "ab"
    assert one(spark, T.normalize_articles_first(F.col("t")), t="a.b") == "b"


@pytest.mark.parametrize("p,g,want", [("", "", 1.0), ("", "x", 0.0), ("the cat", "a cat", 1.0), ("cat cat", "cat", 2 / 3)])
def test_token_f1(spark, p, g, want):
    assert one(spark, metrics.token_scores(F.col("p"), F.col("g"))[2], p=p, g=g) == pytest.approx(want)


def test_strict_f1(spark):
    assert one(spark, metrics.strict_f1(F.col("p"), F.col("g")), p="yes", g="yes it is") == 0


def test_facts_of_nothing(spark):
    pr, rc, f1, em = metrics.fact_scores(F.col("p"), F.col("g"))
    assert one(spark, F.array(pr, rc, f1, em), p=[], g=[]) == [0, 0, 0, 1]


def test_rouge_l_against_a_table(spark):
    import random

    rnd = random.Random(3)
    for _ in range(8):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 9))] for _ in "ab")
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
        want = 1.0 if not a and not b else 0.0 if not a or not b else 2 * dp[-1][-1] / (len(a) + len(b))
        assert one(spark, metrics.rouge_l(F.col("a"), F.col("b")), a=" ".join(a), b=" ".join(b)) == pytest.approx(want)


def test_numbers(spark):
    assert one(spark, T.number_in(F.col("t")), t="$1,234.5%") == 1234.5
    assert one(spark, T.numbers_match(F.col("p"), F.col("g")), p=25.0, g=0.25)
    assert not one(spark, T.numbers_match(F.col("p"), F.col("g")), p=26.0, g=0.25)


def test_abstains_on_nothing(spark):
    assert one(spark, T.abstains(F.col("t")), t="") and one(spark, T.abstains(F.col("t")), t="I don't know.")


def test_coverage_is_by_substring(spark):
    assert one(spark, policy.coverage(F.array(F.lit("art")), F.col("t")), t="a party") == 1.0


def test_rrf_adds_up(spark):
    a = spark.createDataFrame([(1, 7, 1, 2.0), (1, 8, 2, 1.0)], "query_id int, id int, rank int, score double")
    b = spark.createDataFrame([(1, 8, 1, 9.0), (1, 7, 2, 3.0)], "query_id int, id int, rank int, score double")
    got = fusion.rrf([(a, 1.0), (b, 1.0)], 5).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 8]  # equal sums: the first list's raw score decides
    assert got[0].rrf == pytest.approx(1 / 61 + 1 / 62)


def test_sentence_rerank_without_sentences(spark):
    rows = spark.createDataFrame([(1, "big cat", 1, "", 2.0), (1, "big cat", 2, "a cat.", 1.0)], "query_id int, query string, id int, text string, score double")
    got = {r.id: (r.best, r.rank) for r in fusion.sentence_rerank(rows).collect()}
    assert got == {1: (-1.0, 2), 2: (0.5, 1)}


def test_diversify_appends_the_rest(spark):
    hits = spark.createDataFrame([(1, i, d, i) for i, d in enumerate([1, 1, 1, 2], 1)], "query_id int, id int, doc_id int, rank int")
    assert [r.id for r in retrieval.diversify(hits, 4).orderBy("rank").collect()] == [1, 2, 4, 3]
    assert [r.id for r in retrieval.diversify(hits, 4, overflow=False).orderBy("rank").collect()] == [1, 2, 4]


def test_cosine_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.cosine_top_k(q, v, 3, block=2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 60, 10):
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(-(u @ u[i]))[:3].tolist()


def test_ranking_scores(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 6), (2, 9)], "query_id int, id int")
    got = {r.query_id: r for r in metrics.ranking_scores(hits, gold).collect()}
    assert got[1].recall_1 == 0 and got[1].recall_3 == 1 and got[2].ndcg_10 == 0


def test_prices_by_longest_prefix(spark):
    use = spark.createDataFrame([("abc-1", 10, 0, 0), ("zz", 10, 0, 0)], "model string, n_in long, n_cached long, n_out long")
    prices = spark.createDataFrame([("ab", 1.0, 1.0, 1.0), ("abc", 2.0, 1.0, 1.0)], "prefix string, p_in double, p_cached double, p_out double")
    got = {r.model: r.cost for r in metrics.priced(use, prices, (5.0, 5.0, 5.0)).collect()}
    assert got == {"abc-1": pytest.approx(2e-5), "zz": pytest.approx(5e-5)}


def test_pagerank_keeps_its_mass(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 2.0), (2, 3, 1.0)], "src int, dst int, weight double")
    r = {x.node: x["rank"] for x in graph.pagerank(nodes, edges).collect()}
    assert sum(r.values()) == pytest.approx(1) and len(r) == 5


def test_pagerank_by_parts_deals_its_edges_once(spark, monkeypatch):
    plans, write, rnd = {}, graph.written, random.Random(5)
    monkeypatch.setattr(graph, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    edges = [(rnd.randrange(36), rnd.randrange(44), rnd.random()) for _ in range(150)]  # some lead nowhere, some nodes have none
    frame, nodes = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(40).toDF("node")
    for seeds, least, part in ((None, 1e-6, 8), ({3: 2.0, 7: 1.0, 9: -1.0}, 1e-3, 4096)):
        base = {d: max(seeds.get(d, 0), 0) / 3 if seeds else 1 / 40 for d in range(40)}
        total, score = {s: sum(w for a, _, w in edges if a == s) for s, _, _ in edges}, base
        for _ in range(50):
            held = sum(r for d, r in score.items() if d not in total)
            new = {d: 0.15 * b + 0.85 * held * b for d, b in base.items()}
            for a, b, w in edges:
                if b in new:
                    new[b] += 0.85 * score[a] * w / total[a]
            moved, score = sum(abs(new[d] - score[d]) for d in new), new
            if moved < least:
                break
        found = graph.pagerank(nodes, frame, seeds and spark.createDataFrame(list(seeds.items()), "node long, weight double"), least=least, part=part)
        assert {r.node: r["rank"] for r in found.collect()} == pytest.approx(score, abs=1e-12)
    assert plans["rank-round"].count("InMemoryTableScan") >= 10 and not re.search(r"Exchange[^\n]*\n([^\n]*Project[^\n]*\n)*[^\n]*InMemoryTableScan", plans["rank-round"])


def test_packed_units(spark):
    assert one(spark, variants.packed(F.col("u"), 5), u=["ab", "cd", "e", "longer", "x"]) == ["ab cd", "e", "longer", "x"]


def test_structure_chunks_hold_all_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = variants.structure_chunks(docs).toPandas()
    assert (rows.chunk.str.len() <= 512).all()
    words = docs.toPandas().set_index("doc_id").text.str.split().str.len()
    got = rows.assign(n=rows.chunk.str.split().str.len()).groupby("doc_id").n.sum()
    assert (got >= words[got.index]).all()


def test_nqc_reads_a_hundred_scores(spark, data):
    from statistics import fmean, pstdev

    from sparkwell import catalogue as c

    scores = {}
    for r in retrieval.bm25_top_k(c.questions(spark, data), c.read(spark, data, "documents"), "doc_id", "text", 10**6).collect():
        scores.setdefault(r.query_id, []).append(r.score)
    best = {q: sorted(x, reverse=True)[:100] for q, x in scores.items()}
    assert any(len(x) > 20 for x in best.values())
    got = {r.query_id: r.nqc for r in c.QUERIES["nqc_route"](spark, data).collect()}
    assert got == pytest.approx({q: pstdev(x) / fmean(x) for q, x in best.items()}, abs=2e-6)


def test_cosine_takes_queries_in_parts(spark, monkeypatch):
    """No matrix has a row for every query of the set; hits are those of plain numpy."""
    import numpy as np

    class Bounded(retrieval.Best):
        def offer(self, scores, ids, above=-1.0):
            assert len(scores) <= 3, "scores of too many queries at once"
            super().offer(scores, ids, above)

    monkeypatch.setattr(retrieval, "Best", Bounded)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    rnd = np.random.default_rng(5)
    v = rnd.integers(-3, 4, (40, 4)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    queries = vectors.where("id % 4 = 0").withColumnRenamed("id", "query_id").withColumn("k", F.col("query_id").cast("int") % 3 + 2)
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.cosine_top_k(queries, vectors, "k").collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = np.round(unit @ unit.T + 1, 9)
    want = {(q, n + 1): i for q in range(0, 40, 4) for n, i in enumerate(sorted(range(40), key=lambda i: (-score[q, i], i))[: q % 3 + 2])}
    assert got == want


def test_card_and_labels_of_long_texts(spark):
    """Cards and labels against plain Python, and a text is cut into sentences once whatever the number of a card's parts."""
    text = "First one. It came from Rome! Then, due to rain\nhe led. It was in 1999. No x12345 or 1999a; bornéd.\n\nlast"
    df = spark.createDataFrame([(1, "src", text), (2, None, None), (3, "t", "abc"), (4, "", "1234"), (5, "", "é1234 a1234 _1234 12345 1234é")], "i long, s string, t string")
    card = variants.card(F.col("s"), F.col("t"))
    frame = df.select("i", card.alias("k"), variants.taxonomy(F.col("s"), F.col("t")).alias("l"))
    got = {r.i: (tuple(r.k), r.l) for r in frame.collect()}
    assert got[1] == (("It came from Rome!", "First one. It came from Rome!", "No x12345 or 1999a; bornéd.", "first came rome then rain 1999 x12345 1999a"), "temporal/date > entity/person/biography")
    assert got[2] == (("", "", "", ""), "general/fact/entity")
    assert got[3] == (("abc", "abc", "abc", ""), "general/fact/entity")
    assert [got[i][1] for i in (4, 5)] == ["temporal/date", "general/fact/entity"]
    plan = df.select(card.alias("k")).select("k.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
