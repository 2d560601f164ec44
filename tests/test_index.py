"""The kept index, pools of several sizes, several fields, links and communities, against plain Python and the scanning forms."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.operators import graph, links, metrics, retrieval
from sparkwell.operators.postings import Index, counted, index_stream
from sparkwell.plans import index as plans

DOCS = [(1, "red fox jumps"), (2, "red red dog"), (3, None), (4, ""), (5, "blue fox"), (5, "blue fox"), (None, "fox fox Éclair 日本"), (7, "dog " * 400 + "fox")]


def hits_of(df):
    return sorted((str(r.query_id), r["rank"], round(r.score, 6), str(r.id)) for r in df.collect())


def test_word_counts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3)
    for r in counted(docs, "doc_id", "text").collect():
        text = next(t for i, t in DOCS if i == r.id)
        words = re.findall(r"\w+", (text or "").lower())
        assert r.length == len(words) and r.terms == sorted(set(words)) and r.tfs == [words.count(w) for w in sorted(set(words))]


@pytest.mark.parametrize("size,probe", [(1, 1), (2, 2), (64, 4)])
def test_index_equals_the_scan(spark, tmp_path, size, probe):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(2)
    asked = spark.createDataFrame([("a", "the red FOX", 3), ("b", None, 2), ("c", "Blue dog", 1), ("d", "nothing here", 5), ("e", "fox", None)], "query_id string, text string, k int")
    index = Index(spark, f"file://{tmp_path}/i", size)
    index.add(docs, segment=0)
    want = hits_of(retrieval.bm25_top_k(asked, docs, "doc_id", "text", 4))
    assert hits_of(index.search(asked.drop("k"), 4, probe)) == want
    own = {"a": 3, "b": 2, "c": 1, "d": 5, "e": 4}
    assert hits_of(index.search(asked, 4, probe)) == [h for h in hits_of(retrieval.bm25_top_k(asked, docs, "doc_id", "text", 5)) if h[1] <= own[h[0]]]


def test_index_grows_by_batches(spark, data, tmp_path):
    """Segment by segment, with a segment written twice, and after compaction, it ranks as the scan does over the same documents."""
    docs = c.read(spark, data, "documents").select("doc_id", "text")
    q = c.questions(spark, data)
    index = Index(spark, f"file://{tmp_path}/i", 8)
    index.add(docs.where("doc_id % 3 = 0"), segment=0)
    assert hits_of(index.search(q, 5)) == hits_of(retrieval.bm25_top_k(q, docs.where("doc_id % 3 = 0"), "doc_id", "text", 5))
    for _ in range(2):
        index.add(docs.where("doc_id % 3 > 0"), segment=1)
    want = hits_of(retrieval.bm25_top_k(q, docs, "doc_id", "text", 5))
    assert hits_of(index.search(q, 5)) == want
    assert hits_of(index.compact(f"file://{tmp_path}/j").search(q, 5)) == want
    hits, judged = index.waves(q, 5)
    row = judged.agg(F.sum("blocks").alias("n"), F.sum(F.when(F.col("wave").isNotNull(), F.col("blocks"))).alias("read")).first()
    assert 0 < row.read <= row.n


def test_an_unfinished_segment_isnt_there(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    q = spark.createDataFrame([("a", "red fox")], "query_id string, text string")
    index = Index(spark, f"file://{tmp_path}/i")
    index.add(docs, segment=0)
    before = hits_of(index.search(q, 9))
    index.write(index.numbered(counted(docs, "doc_id", "text")), "docs", 1)  # its writer died before the blocks
    assert hits_of(index.search(q, 9)) == before


def test_a_search_keeps_few_rows_of_a_task(spark, tmp_path):
    """Every document is a hit, and a task gives the k best of each query alone, whatever ranges it scores."""
    docs = spark.createDataFrame([(i, "red fox") for i in range(800)], "doc_id int, text string").repartition(2)
    q = spark.createDataFrame([("a", "fox"), ("b", "red fox")], "query_id string, text string")
    index = Index(spark, f"file://{tmp_path}/i", 8)
    index.add(docs)
    assert index.blocks().count() == index.docs().select("range").distinct().count() >= 100
    hits, judged = index.waves(q, 3)
    assert judged.where("wave is not null").count() >= 200
    assert hits.count() <= 2 * 3 * hits.rdd.getNumPartitions() < 800
    assert hits_of(index.search(q, 3)) == hits_of(retrieval.bm25_top_k(q, docs, "doc_id", "text", 3))


def test_index_of_a_stream(spark, data, tmp_path):
    docs = c.read(spark, data, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        index_stream(stream, f"file://{tmp_path}/i", f"file://{tmp_path}/c").awaitTermination()
    q = c.questions(spark, data)
    index = Index(spark, f"file://{tmp_path}/i")
    assert index.blocks().select("segment").distinct().count() == 3
    assert hits_of(index.search(q, 5)) == hits_of(retrieval.bm25_top_k(q, docs, "doc_id", "text", 5))


def test_pools_of_their_own(spark, data):
    docs, q = c.read(spark, data, "documents"), c.questions(spark, data)
    sized = q.withColumn("pool", F.when(F.col("query_id") % 3 == 0, None).when(F.col("query_id") % 3 == 1, 2).otherwise(7).cast("int"))
    of = {r.query_id: r.pool or 0 for r in sized.collect()}
    whole = hits_of(retrieval.bm25_top_k(q, docs, "doc_id", "text", 7))
    got = hits_of(retrieval.bm25_top_k(sized, docs, "doc_id", "text", "pool", block=5))
    assert got == [h for h in whole if h[1] <= of[int(h[0])]] and got != whole
    v = c.read(spark, data, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vq = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding", (F.col("id") % 5 + 1).alias("pool"))
    near = hits_of(retrieval.cosine_top_k(vq.drop("pool"), v, 5))
    assert hits_of(retrieval.cosine_top_k(vq, v, "pool")) == [h for h in near if h[1] <= int(h[0]) % 5 + 1]


@pytest.mark.parametrize("total,every", [(False, False), (True, False), (True, True)])
def test_fields_in_one_pass(spark, total, every):
    """Two fields against one search for each."""
    rnd = random.Random(4)
    docs = [(i, *(" ".join(rnd.choice(["ant", "bee", "cow", "dog", "eel"]) for _ in range(rnd.randint(0, 6))) or None for _ in "ab")) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id int, t string, b string").repartition(3)
    asked = [("x", "ant bee"), ("y", "cow"), ("z", None)]
    q = spark.createDataFrame(asked, "query_id string, text string")
    parts = {}
    for name, boost in (("t", 3.0), ("b", 2.0)):
        for r in retrieval.bm25_top_k(q, frame, "doc_id", name, 100).collect():
            parts.setdefault((r.query_id, r.id), []).append(boost * r.score)
    words = {i: set(f"{t or ''} {b or ''}".split()) for i, t, b in docs}
    want = {}
    for (query, i), scores in parts.items():
        if not every or set(dict(asked)[query].split()) <= words[i]:
            want.setdefault(query, []).append((-round(sum(scores) if total else max(scores), 9), i))
    got = retrieval.fields_top_k(q, frame, "doc_id", {"t": 3.0, "b": 2.0}, 10, total, every, block=2).orderBy("query_id", "rank").collect()
    for query in ("x", "y", "z"):
        assert [r.id for r in got if r.query_id == query] == [i for _, i in sorted(want.get(query, []))[:10]]


def test_pool_rules(spark):
    q = spark.createDataFrame([(1, "which river is longer"), (2, "compare the two rivers"), (3, None)], "query_id int, text string")
    got = {r.query_id: (r.pool, r.asked) for r in plans.pools(q, 5).collect()}
    assert got[1] == (10, "which river is longer") and got[2] == (15, "compare two rivers") and got[3][0] == 10
    terms, texts = ["aaa", "bbb", "ccc"], ["an aaa and bbb", "bbb ccc", "x"]
    row = spark.createDataFrame([(terms, texts)], "t array<string>, x array<string>").select(plans.quality(F.col("t"), F.col("x"))).first()[0]
    assert row == pytest.approx(1.0)


def test_poor_hits_are_corrected(spark):
    """A question most of whose terms aren't found is asked again in its terms, from a pool of four times k; rich ones were asked so already."""
    docs = spark.createDataFrame([(i, f"the river number{i} and the fox{i % 3}") for i in range(30)] + [(99, None)], "doc_id long, text string")
    asked = [(1, "a river and the fox1"), (2, "zebra okapi quagga river"), (3, "the zebra of okapi and quagga in river"), (4, "compare zebra okapi quagga unicorn"), (5, None), (6, "the")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    rows = plans.corrected(q, docs, 2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r.query_id, r.corrected), []).append(r.id)
    # 2 is its own terms already, and 4 is rich: neither is asked again; 3 is
    assert {k for k in got if k[1]} == {(3, True)} and (2, False) in got and (4, False) in got
    again = plans.pooled(spark.createDataFrame([(3, "zebra okapi quagga river", 8)], "query_id long, asked string, pool int"), docs, 2)
    assert got[3, True] == [r.id for r in again.orderBy("rank").collect()]
    once = plans.pooled(plans.pools(q.where("query_id in (1, 2, 4)"), 2), docs, 2).orderBy("query_id", "rank").collect()
    assert [(q_, i) for (q_, _), ids in sorted(got.items()) if q_ in (1, 2, 4) for i in ids] == [(r.query_id, r.id) for r in once]


def test_rare_names_link(spark):
    rows = [(d, "pair") for d in (1, 2)] + [(d, "four") for d in (1, 2, 3, 9)] + [(d, "common") for d in range(6)] + [(1, "alone"), (1, "pair"), (None, "pair"), (4, None)]
    got = {(r.a, r.b): r.weight for r in links.shared_names(spark.createDataFrame(rows, "doc_id int, entity string"), rare=5).collect()}
    four = 1 / math.log2(5)
    assert got == pytest.approx({(1, 2): 1 / math.log2(3) + four, (1, 3): four, (2, 3): four, (2, 9): four, (3, 9): four})


def plain_modularity(edges, of):
    total = 2 * sum(w for *_, w in edges)
    inner, whole = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            whole[of[x]] = whole.get(of[x], 0) + w
        if of[a] == of[b]:
            inner[of[a]] = inner.get(of[a], 0) + 2 * w
    return sum(inner.get(k, 0) / total - (v / total) ** 2 for k, v in whole.items())


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def test_communities_of_small_graphs_are_the_best(spark):
    """Against every partition of the nodes."""
    graphs = [
        [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.5)],
        [(0, 1, 2.0), (1, 2, 0.2), (2, 3, 2.0), (3, 4, 0.2), (4, 5, 2.0), (5, 6, 0.1)],
    ]
    for edges in graphs:
        frame = spark.createDataFrame(edges, "a long, b long, weight double")
        found = {r.node: r.community for r in links.louvain(frame).collect()}
        nodes = sorted({x for a, b, _ in edges for x in (a, b)})
        best = max(plain_modularity(edges, {x: k for k, part in enumerate(p) for x in part}) for p in partitions(nodes))
        assert set(found) == set(nodes) and all(found[k] == k for k in found.values())
        assert plain_modularity(edges, found) == pytest.approx(best)
        assert links.modularity(frame, spark.createDataFrame(list(found.items()), "node long, community long")) == pytest.approx(best)


def test_communities_of_planted_groups(spark):
    rnd = random.Random(2)
    groups = {x: x // 12 for x in range(60)}
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(60), 2) if rnd.random() < (0.6 if groups[a] == groups[b] else 0.02)]
    found = {r.node: r.community for r in links.louvain(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert plain_modularity(edges, found) > plain_modularity(edges, groups) - 0.01
    assert links.louvain(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_rounds_of_communities_collect_no_side_of_a_join(spark, monkeypatch):
    plans, write = [], links.written
    monkeypatch.setattr(links, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rnd = random.Random(3)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(24), 2) if rnd.random() < (0.7 if a // 8 == b // 8 else 0.05)]
    assert {r.community for r in links.louvain(spark.createDataFrame(edges, "a long, b long, weight double")).collect()} == {0, 8, 16}
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_communities_know_names_behind_the_sixteenth(spark, tmp_path):
    text = lambda d, *more: ", ".join([*(f"Alpha{x}{d}" for x in "bcdefghijklmnopqrs"), *more])
    rows = [(1, text(1, "Zenith"), "s1"), (2, text(2, "Zenith"), "s2"), (3, text(3, "Omega Quuxa", "Omega Quuxb"), "s3")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.community for r in c.QUERIES["linked_communities"](spark, str(tmp_path)).collect()} == {1: "linked:1", 2: "linked:1", 3: "omega"}


def test_all_pairs_of_a_rare_name_link(spark):
    rows = [(d, "five") for d in (5, 1, 2, 3, 9)] + [(d, "pair") for d in (1, 9)] + [(1, "pair"), (7, "alone"), (None, "pair")] + [(100 + d, "common") for d in range(links.RARE + 1)]
    m = spark.createDataFrame(rows, "doc_id int, entity string")
    got = {(r.a, r.b): r.weight for r in links.shared_names(m).collect()}
    five = 1 / math.log2(6)
    assert got == pytest.approx({p: five + (p == (1, 9)) / math.log2(3) for p in itertools.combinations((1, 2, 3, 5, 9), 2)})


@pytest.mark.parametrize("part", [2, 4096])
def test_ranks_by_names_equal_those_over_all_pairs(spark, part):
    rnd = random.Random(4)
    rows = [(d, f"n{e}") for d in range(30) for e in rnd.sample(range(14), 3)] + [(40, "alone"), (None, "n1")]
    rare = links.rare_names(spark.createDataFrame(rows, "doc_id int, entity string")).select(F.col("doc_id").alias("node"), F.col("entity").alias("name"), "weight")
    pairs = links.shared_names(spark.createDataFrame(rows, "doc_id int, entity string"))
    nodes = spark.createDataFrame([(d,) for d in [*range(30), 40, 41]], "node int")
    want = {r.node: r["rank"] for r in graph.pagerank(nodes, links.both_ways(pairs), rounds=12).collect()}
    assert len(set(want.values())) > 20
    assert {r.node: r["rank"] for r in graph.pagerank_by_names(nodes, rare, rounds=12, part=part).collect()} == pytest.approx(want, abs=1e-12)
    assert graph.pagerank_by_names(nodes.where("false"), rare.where("false"), rounds=2).count() == 0


def test_communities_by_names_equal_those_of_all_pairs(spark):
    """A turn's gains are the same, whether a name's pairs are made or its nodes counted by community."""
    rnd = random.Random(6)
    rows = [(d, f"n{rnd.randrange(4) + 5 * (d // 12)}") for d in range(60) for _ in range(3)] + [(d, f"x{d % 7}") for d in rnd.sample(range(60), 12)]
    m = spark.createDataFrame(rows + [(99, "alone")], "doc_id long, entity string")
    names = links.rare_names(m).select(F.col("doc_id").alias("node"), F.col("entity").alias("name"), "weight")
    pairs = links.shared_names(m)
    edges = [tuple(r) for r in pairs.collect()]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    k = {x: sum(w * ((a == x) + (b == x)) for a, b, w in edges) for x in nodes}
    now = spark.createDataFrame([(x, k[x], x // 6) for x in nodes], "node long, k double, community long")
    total = sum(k.values())
    for turn in (0, 1):
        want, got = ({r.node: r.community for r in links.moved(near, now, total, turn).collect()} for near in (links.by_links(links.both_ways(pairs)), links.by_names(names)))
        assert got == want and got != {x: x // 6 for x in nodes}
    found = {r.node: r.community for r in links.louvain_by_names(names).collect()}
    assert found == {r.node: r.community for r in links.louvain(pairs).collect()} and set(found) == set(nodes)
    assert links.louvain_by_names(names.where("false")).count() == 0


def test_linked_queries(spark, data):
    own = {r.doc_id: r.community for r in c.QUERIES["linked_communities"](spark, data).collect()}
    docs = c.read(spark, data, "documents")
    assert len(own) == docs.select("doc_id").distinct().count()
    edges = [tuple(r) for r in links.shared_names(c.doc_mentions(spark, data)).collect()]
    linked = {d: own[d] for a, b, _ in edges for d in (a, b)}
    assert all(v.startswith("linked:") for v in linked.values())
    assert plain_modularity(edges, linked) > plain_modularity(edges, {d: d for d in linked})
    ranks = {r.doc_id: r["rank"] for r in c.QUERIES["linked_ranks"](spark, data).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-5) and len(ranks) == len(own)
    # a walk by hand
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = out.setdefault(b, {})[a] = w
    score = {d: 1 / len(own) for d in own}
    for _ in range(50):
        lost = sum(s for d, s in score.items() if d not in out)
        new = {d: 0.15 / len(own) + 0.85 * lost / len(own) for d in own}
        for d, to in out.items():
            for e, w in to.items():
                new[e] += 0.85 * score[d] * w / sum(to.values())
        score = new
    assert ranks == pytest.approx(score, abs=1e-5)
    assert metrics.unique_ranks(c.QUERIES["linked_route"](spark, data), 2).count() > 0
