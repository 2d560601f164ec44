"""Retrieval in rounds around a model's texts: what surrounds the model is relational, the model is a provider of columns.

A provider has two methods: rewrite(query, round) and draft(query, context), each from columns to a column.  `Terms` is a
deterministic one for tests and for runs without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T
from sparkwell.operators import fusion, ingest, policy, retrieval
from sparkwell.storage import ensure_checkpoints


class Terms:
    """Rewrites a query to its terms from the round on; drafts by adding a context's first sentence."""

    def rewrite(self, query: Column, round_: int) -> Column:
        return F.array_join(F.slice(T.query_terms(query), round_ + 1, 8), " ")

    def draft(self, query: Column, context: Column) -> Column:
        return F.concat_ws(" ", query, F.get(T.sentences(context), F.lit(0)))


def in_rounds(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], provider, most: int = 3) -> DataFrame:
    """(query_id, round, id, text, rank): contexts of queries (query_id, text), round after round, until the trace says stop.

    retrieve gives (query_id, id, text, rank), and title if it has one, for (query_id, text).  The first round asks the query itself, later ones the
    provider's rewriting.  Each round is checkpointed; queries that have stopped aren't asked again.
    """
    ensure_checkpoints(queries.sparkSession)
    terms = queries.select("query_id", T.query_terms(F.col("text")).alias("terms"), F.col("text").alias("whole"))
    asked, out = queries.select("query_id", "text"), None
    for n in range(most):
        found = retrieve(asked)
        titled = ["title"] if "title" in found.columns else []
        rows = found.select("query_id", F.lit(n).alias("round"), "id", *titled, "text", "rank")
        out = (rows if out is None else out.unionByName(rows)).checkpoint()
        trace = policy.trace(out.join(terms.drop("whole"), "query_id").select("query_id", "round", "id", "terms", *titled, "text")).where(F.col("round") == n)
        stop = policy.should_stop(F.col("coverage"), F.col("supportive"), F.col("novelty"), F.col("gain"), F.col("round"))
        asked = terms.join(trace.where(~stop).select("query_id"), "query_id").select("query_id", provider.rewrite(F.col("whole"), n + 1).alias("text"))
    return out


def final_contexts(rounds: DataFrame, k: int) -> DataFrame:
    """(query_id, id, place): what the rounds have found, each context once by its first appearance, twice k in all."""
    first = rounds.groupBy("query_id", "id").agg(F.min(F.struct("round", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    return first.withColumn("place", place).where(F.col("place") <= 2 * k).select("query_id", "id", "place")


def opened_around(hits: DataFrame, chunks: DataFrame, each: int = 2, most: int = 2) -> DataFrame:
    """(query_id, round, doc_id, chunk_index, chunk): chunks around the hits, `each` of them a round, none of them opened twice by a query."""
    turns = hits.where(F.col("rank") <= each * most).withColumn("round", F.expr(f"(rank - 1) div {each}"))
    spots = turns.select("query_id", "round", "doc_id", F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).where("chunk_index >= 0")
    once = spots.groupBy("query_id", "doc_id", "chunk_index").agg(F.min("round").alias("round"))
    return once.join(chunks, ["doc_id", "chunk_index"]).select("query_id", "round", "doc_id", "chunk_index", "chunk")


def lexical(spark, sf_dir, k: int) -> Callable[[DataFrame], DataFrame]:
    docs = c.read(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return lambda asked: retrieval.bm25_top_k(asked, docs, "doc_id", "text", k).join(texts, "id").select("query_id", "id", "text", "rank")


@c.query()
def retrieval_rounds(spark, sf_dir):
    return in_rounds(c.questions(spark, sf_dir), lexical(spark, sf_dir, 5), Terms()).select("query_id", "round", "id", "rank")


@c.query()
def final_read(spark, sf_dir):
    return final_contexts(in_rounds(c.questions(spark, sf_dir), lexical(spark, sf_dir, 5), Terms()), 5)


@c.query(
    f"""WITH {c.DOC_BM25}, {c.top_sql("m", 5, "a")}, dr AS (SELECT b.item_id AS query_id, concat_ws(' ', b.text, ({c.SENTENCES.format("d.text")})[1]) AS text FROM benchmark b JOIN a ON a.query_id = b.item_id AND a.rank = 1 JOIN documents d ON d.doc_id = a.id),
{c.bm25_sql("documents", "doc_id", "text", "n", "dr")}, {c.top_sql("n", 5, "b")}, z AS (SELECT query_id, id, 0 AS p, rank FROM a UNION ALL SELECT query_id, id, 1, rank FROM b), o AS (SELECT query_id, id, min((p, rank)) AS pl FROM z GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pl, id) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pl, id) <= 8"""
)
def draft_union(spark, sf_dir):
    """What the query finds, then what a draft from its best hit finds."""
    q, find = c.questions(spark, sf_dir), lexical(spark, sf_dir, 5)
    hits = find(q)
    drafts = q.withColumnRenamed("text", "query").join(hits.where("rank = 1").select("query_id", "text"), "query_id").select("query_id", Terms().draft(F.col("query"), F.col("text")).alias("text"))
    return fusion.anchors_first(hits, find(drafts), 8, first=5)


@c.query(
    f"""WITH {c.CHUNK_BM25}, {c.top_sql("m", 4, "t")}, s AS (SELECT query_id, (rank - 1) // 2 AS round, id.doc_id AS doc_id, id.chunk_index + unnest([-1, 0, 1]) AS chunk_index FROM t),
o AS (SELECT query_id, doc_id, chunk_index, min(round) AS round FROM s GROUP BY 1, 2, 3) SELECT query_id, round, doc_id, o.chunk_index, chunk FROM o JOIN chunks USING (doc_id, chunk_index)"""
)
def read_around(spark, sf_dir):
    """Two hits a round are opened with what stands beside them."""
    return opened_around(c.chunk_hits(spark, sf_dir, 4), ingest.chunks(c.read(spark, sf_dir, "documents")))
