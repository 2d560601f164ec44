"""Queries over a kept index, pools of a size of their own for each query, and search by several fields at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell import storage
from sparkwell.functions import text as T
from sparkwell.operators import fusion, policy, retrieval, variants
from sparkwell.operators.postings import Index
from sparkwell.plans import hybrid, records, rounds


def indexed(spark, sf_dir) -> Index:
    """All documents, two thirds of them first and the others as a batch that came later; documents of a source stand together."""
    index = Index(spark, storage.scratch(spark, "index"))
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    late = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, F.lit(True))
    index.add(docs.where(~late), segment=0, order=("lang", "source", "doc_id"))
    index.add(docs.where(late), segment=1, order=("lang", "source", "doc_id"))
    return index


@c.query(f"WITH {c.DOC_BM25}, {c.top_sql('m', 5, 't')} SELECT query_id, id, rank, round(score, 6) AS score FROM t")
def postings_topk(spark, sf_dir):
    """The five best documents by the index."""
    return indexed(spark, sf_dir).search(c.questions(spark, sf_dir), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@c.query()
def postings_pruned(spark, sf_dir):
    """How many blocks of postings each question's terms have, and how many of them its search reads."""
    _, judged = indexed(spark, sf_dir).waves(c.questions(spark, sf_dir), 5)
    return judged.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("wave").isNotNull(), F.col("blocks")).otherwise(0)).alias("read"))


#: A pool has so many times k documents: usually, for rich questions, and where what was found isn't good enough.
USUAL, RICH, CORRECTED = 2, 3, 4
LEAST_QUALITY = 0.45


def pools(queries: DataFrame, k: int) -> DataFrame:
    """queries (query_id, text) with pool, the candidates to be fetched, and asked: rich questions are rewritten and get more."""
    rich = policy.rich_route(F.col("text"))
    return queries.withColumn("pool", F.when(rich, RICH * k).otherwise(USUAL * k)).withColumn("asked", F.when(rich, T.first_filled(rounds.Terms().rewrite(F.col("text"), 0), F.col("text"))).otherwise(F.col("text")))


def quality(terms: Column, texts: Column) -> Column:
    """0.7 of the terms' coverage by the texts together, 0.3 for two that have two terms or more; 0 without either."""
    hits = F.transform(texts, lambda x: F.filter(terms, lambda t: F.lower(x).contains(t)))
    cov = F.size(F.array_distinct(F.flatten(hits))) / F.size(terms)
    several = F.size(F.filter(hits, lambda h: F.size(h) >= 2))
    return F.when((F.size(terms) > 0) & (F.size(texts) > 0), 0.7 * cov + 0.3 * F.least(several / 2, F.lit(1.0))).otherwise(0.0)


def pooled(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank, score): k fused hits of dense and lexical pools, one pass over docs for each list whatever the pools' sizes."""
    q = asked.select("query_id", F.col("asked").alias("text"), "pool")
    vectors = docs.select(F.col("doc_id").alias("id"), hybrid.embedding.hashed_vector(F.col("text")).alias("embedding"))
    dense = retrieval.cosine_top_k(q.select("query_id", hybrid.embedding.hashed_vector(F.col("text")).alias("embedding"), "pool"), vectors, "pool")
    lexical = retrieval.bm25_top_k(q, docs, "doc_id", "text", "pool")
    return fusion.rrf([(dense, 1.0), (lexical, 1.0)], k)


def corrected(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank, corrected): pooled hits; of questions whose hits aren't good enough, those of a rewritten question's larger pool.

    A question that was asked in its rewritten form already isn't asked again.
    """
    first = storage.written(pools(queries, k), "pools")
    hits = storage.written(pooled(first, docs, k), "pooled")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    told = hits.join(texts, "id").groupBy("query_id").agg(F.collect_list("body").alias("bodies"))  # k texts
    rows = first.join(told, "query_id", "left").withColumn("bodies", F.coalesce("bodies", F.array().cast("array<string>")))
    rewritten = T.first_filled(rounds.Terms().rewrite(F.col("text"), 0), F.col("text"))
    poor = F.round(quality(T.query_terms(F.col("text")), F.col("bodies")), 9) < LEAST_QUALITY
    again = storage.written(rows.where(poor & (rewritten != F.col("asked"))).select("query_id", rewritten.alias("asked"), F.lit(CORRECTED * k).alias("pool")), "again")
    second = pooled(again, docs, k).select("query_id", "id", "rank", F.lit(True).alias("corrected"))
    return hits.join(again.select("query_id"), "query_id", "left_anti").select("query_id", "id", "rank", F.lit(False).alias("corrected")).unionByName(second)


RICH_SQL = "(len(string_split(" + c.SQUEEZE.format("text") + ", ' ')) >= 12 OR " + " OR ".join(f"contains(lower(text), '{x}')" for x in policy.RICH_CUES) + ")"
#: All terms of a text, in order, repeated ones too.
ALL_TERMS = c.TERMS.removeprefix("list_distinct(").removesuffix(")")
POOLS = f"""pw AS (SELECT item_id AS query_id, text, {RICH_SQL} AS rich, {ALL_TERMS.format("text")} AS ws FROM benchmark), pq AS (SELECT query_id, text, rich, array_to_string(list_filter(ws, lambda t, i: list_position(ws, t) = i)[1:8], ' ') AS rw FROM pw),
pa AS (SELECT query_id, text AS whole, CASE WHEN rich THEN 15 ELSE 10 END AS pool, CASE WHEN rich AND rw <> '' THEN rw ELSE text END AS asked, CASE WHEN rw <> '' THEN rw ELSE text END AS rw FROM pq)"""


def pool_sql(asked: str, tag: str) -> str:
    """CTEs that end in g{tag}: five fused hits of asked (query_id, text, pool)."""
    return f"""{c.bm25_sql("documents", "doc_id", "text", f"m{tag}", f"(SELECT query_id, text FROM {asked})")}, {c.top_sql(f"m{tag}", 40, f"l0{tag}")}, l{tag} AS (SELECT l0{tag}.* FROM l0{tag} JOIN {asked} USING (query_id) WHERE rank <= pool),
{hybrid.cosine_sql(40, f"d0{tag}", f"(SELECT query_id, text FROM {asked})")}, d{tag} AS (SELECT d0{tag}.* FROM d0{tag} JOIN {asked} USING (query_id) WHERE rank <= pool),
u{tag} AS (SELECT query_id, id, 0 AS list, rank, score, 1.0 / (60 + rank) AS w FROM d{tag} UNION ALL SELECT query_id, id, 1, rank, score, 1.0 / (60 + rank) FROM l{tag}), f{tag} AS (SELECT query_id, id, sum(w) AS rrf, min((list, rank, score)) AS first FROM u{tag} GROUP BY ALL),
g{tag} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, round(first[3], 9) DESC, first[1], first[2], id) AS rank FROM f{tag} QUALIFY rank <= 5)"""


@c.query(f"WITH {POOLS}, a1 AS (SELECT query_id, asked AS text, pool FROM pa), {pool_sql('a1', 1)} SELECT query_id, id, rank FROM g1")
def pooled_contexts(spark, sf_dir):
    """Each question's fused hits from pools of its own size."""
    return pooled(pools(c.questions(spark, sf_dir), 5), c.read(spark, sf_dir, "documents"), 5).select("query_id", "id", "rank")


@c.query(
    f"""WITH {POOLS}, a1 AS (SELECT query_id, asked AS text, pool FROM pa), {pool_sql('a1', 1)}, ts AS (SELECT query_id, whole, asked, rw, {c.TERMS.format("whole")} AS ts FROM pa), tb AS (SELECT query_id, id, lower(coalesce(text, '')) AS b FROM g1 JOIN documents ON doc_id = id),
th AS (SELECT query_id, id, list_filter(ts, lambda t: contains(b, t)) AS h FROM tb JOIN ts USING (query_id)), tq AS (SELECT query_id, len(list_distinct(flatten(list(h)))) AS m, count(*) FILTER (len(h) >= 2) AS s FROM th GROUP BY 1),
po AS (SELECT query_id, rw AS text, 20 AS pool FROM ts LEFT JOIN tq USING (query_id) WHERE round(CASE WHEN len(ts) > 0 AND m IS NOT NULL THEN 0.7 * m / len(ts) + 0.3 * least(s / 2, 1.0) ELSE 0 END, 9) < 0.45 AND rw <> asked), {pool_sql('po', 2)}
SELECT query_id, id, rank, false AS corrected FROM g1 WHERE query_id NOT IN (SELECT query_id FROM po) UNION ALL SELECT query_id, id, rank, true FROM g2"""
)
def corrected_contexts(spark, sf_dir):
    """Questions whose hits don't cover them are asked again, in other words and from a larger pool."""
    return corrected(c.questions(spark, sf_dir), c.read(spark, sf_dir, "documents"), 5)


# What a field's score counts for in the searches of records.
CARD_FIELDS = {"title": 4.0, "body": 3.0, "card": 3.0, "terms": 2.0}
LABEL_FIELDS = {"title": 2.0, "body": 3.0, "labels": 4.0}
ROW_FIELDS = {"body": 3.0, "row_text": 4.0, "title": 2.0}


def carded(docs: DataFrame) -> DataFrame:
    """(doc_id, title, body, card, terms, labels, row_text): a document's fields for search; the source stands for the title."""
    given = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), variants.card(F.col("source"), F.col("text")).alias("k"), variants.taxonomy(F.col("source"), F.col("text")).alias("labels"))
    rows = given.select("doc_id", "title", "body", "k.cause", "k.evidence", "k.resolution", "k.terms", "labels")
    first = F.slice(T.sentences(F.col("body")), 1, records.ROWS)
    return rows.select("doc_id", "title", "body", variants.card_text(F.col("title"), F.col("cause"), F.col("evidence"), F.col("resolution"), F.col("terms")).alias("card"), "terms", "labels", F.array_join(first, "\n").alias("row_text"))


def fielded(spark, sf_dir, fields: dict[str, float], total: bool = False) -> DataFrame:
    docs = carded(c.read(spark, sf_dir, "documents")).select("doc_id", *fields)
    return retrieval.fields_top_k(c.questions(spark, sf_dir), docs, "doc_id", fields, 5, total).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


CARDED = f"""cd0 AS (FROM ({c.ORACLE["knowledge_card"]})), lb0 AS (FROM ({c.ORACLE["taxonomy_label"]})), cd AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS body, 'KNOWLEDGE_CARD' || chr(10) || 'TITLE: ' || coalesce(source, '') || chr(10) || 'PROBLEM: ' || coalesce(source, '') || chr(10) || 'CAUSE: ' || cause || chr(10) || 'EVIDENCE: ' || evidence || chr(10) || 'RESOLUTION: ' || resolution || chr(10) || 'CARD_TERMS: ' || terms AS card,
terms, labels, array_to_string(({c.SENTENCES.format("coalesce(text, '')")})[1:8], chr(10)) AS row_text FROM documents JOIN cd0 USING (doc_id) JOIN lb0 USING (doc_id))"""


def fields_sql(fields: dict[str, float], how: str) -> str:
    parts = ", ".join(c.bm25_sql("cd", "doc_id", name, f"f{i}") for i, name in enumerate(fields))
    union = " UNION ALL ".join(f"SELECT query_id, id, {boost} * score AS score FROM f{i}" for i, boost in enumerate(fields.values()))
    return f"WITH {CARDED}, {parts}, s AS (SELECT query_id, id, {how}(score) AS score FROM ({union}) GROUP BY ALL), {c.top_sql('s', 5, 't')} SELECT query_id, id, rank, round(score, 6) AS score FROM t"


@c.query(fields_sql(CARD_FIELDS, "max"))
def card_search(spark, sf_dir):
    """Documents by title, text, knowledge card and the card's terms, in one pass; the best field counts."""
    return fielded(spark, sf_dir, CARD_FIELDS)


@c.query(fields_sql(LABEL_FIELDS, "max"))
def label_search(spark, sf_dir):
    return fielded(spark, sf_dir, LABEL_FIELDS)


@c.query(fields_sql(ROW_FIELDS, "sum"))
def row_search(spark, sf_dir):
    """Documents by text, rows and title, whose scores are added up."""
    return fielded(spark, sf_dir, ROW_FIELDS, total=True)


# Fixed value: under this ratio of pairs the dense list doesn't tell its hits apart.
LEAST_RATIO = 1.15


def pair_routed(spark, sf_dir, k: int = 5) -> DataFrame:
    """(query_id, id, rank, lexical): the lexical list alone where the dense hits' pairs are too much alike, else both fused."""
    docs, q = c.read(spark, sf_dir, "documents"), c.questions(spark, sf_dir)
    vectors = docs.where(F.trim("text") != "").select(F.col("doc_id").alias("id"), hybrid.embedding.hashed_vector(F.col("text")).alias("embedding"))
    own = q.select("query_id", hybrid.embedding.hashed_vector(F.col("text")).alias("query"))
    dense, lexical = (storage.written(x, "list") for x in hybrid.lists(spark, sf_dir, 2 * k))
    ratio = policy.pair_ratio(dense.join(own, "query_id").join(vectors, "id").select("query_id", "id", "query", "embedding"))
    low = storage.written(ratio.where(F.round("ratio", 9) < LEAST_RATIO).select("query_id"), "low")
    alone = lexical.where(F.col("rank") <= k).join(low, "query_id", "left_semi").select("query_id", "id", "rank", F.lit(True).alias("lexical"))
    fused = fusion.rrf([(dense, 1.0), (lexical, 1.0)], k).join(low, "query_id", "left_anti").select("query_id", "id", "rank", F.lit(False).alias("lexical"))
    return alone.unionByName(fused)


@c.query()
def pair_route(spark, sf_dir):
    return pair_routed(spark, sf_dir)
