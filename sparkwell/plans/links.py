"""Queries over the documents' links: the links, their communities, and routes by a rank that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell import storage
from sparkwell.operators import graph, links, retrieval


def document_chains(spark, sf_dir) -> DataFrame:
    return links.shared_names(c.doc_mentions(spark, sf_dir), links.RARE, links.REACH)


def rare_names(m: DataFrame) -> DataFrame:
    """(node, name, weight): documents and their rare names; all pairs that share one are linked."""
    return links.rare_names(m).select(F.col("doc_id").alias("node"), F.col("entity").alias("name"), "weight")


LINKS = f"""{c.NAMES}, lf AS (SELECT entity, count(DISTINCT doc_id) AS f FROM m GROUP BY 1 HAVING f BETWEEN 2 AND {links.RARE}), lo AS (SELECT DISTINCT doc_id, entity, f FROM m JOIN lf USING (entity)),
ln AS (SELECT doc_id AS a, unnest([lead(doc_id, 1) OVER w, lead(doc_id, 2) OVER w]) AS b, 1 / log2(1 + f) AS v FROM lo WINDOW w AS (PARTITION BY entity ORDER BY doc_id)), links AS (SELECT a, b, sum(v) AS weight FROM ln WHERE b IS NOT NULL GROUP BY 1, 2)"""


@c.query(f"WITH {LINKS} SELECT a, b, round(weight, 6) AS weight FROM links")
def related_documents(spark, sf_dir):
    """Documents that share rare names, each name's documents in a chain with a reach of two."""
    return document_chains(spark, sf_dir).select("a", "b", F.round("weight", 6).alias("weight"))


@c.query()
def linked_communities(spark, sf_dir):
    """Communities of the linked documents by modularity; other documents stay with their names' group.  All names of a document count."""
    docs = c.read(spark, sf_dir, "documents")
    m = storage.written(graph.all_mentions(docs), "mentions")
    own = links.louvain_by_names(rare_names(m)).select(F.col("node").alias("doc_id"), F.concat(F.lit("linked:"), F.col("community").cast("string")).alias("linked"))
    rows = graph.document_groups(docs, m).join(own, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("linked", "community").alias("community"))


@c.query(
    f"WITH {LINKS} SELECT count(*) AS links, round(sum(weight), 4) AS weight, (SELECT count(DISTINCT d) FROM (SELECT a AS d FROM links UNION ALL SELECT b FROM links)) AS documents FROM links"
)
def link_statistics(spark, sf_dir):
    found = storage.written(document_chains(spark, sf_dir), "links")
    ends = found.select(F.col("a").alias("d")).unionByName(found.select(F.col("b").alias("d"))).agg(F.countDistinct("d").alias("documents"))
    return found.agg(F.count("*").alias("links"), F.round(F.sum("weight"), 4).alias("weight")).crossJoin(F.broadcast(ends))  # one row each


def document_ranks(spark, sf_dir, m: DataFrame) -> DataFrame:
    """(node, rank): PageRank of all documents, each linked to all that it shares a rare name with; those without links hold what the base gives them."""
    nodes = c.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node")).where("node is not null")
    return graph.pagerank_by_names(nodes, rare_names(m))


@c.query()
def linked_ranks(spark, sf_dir):
    return document_ranks(spark, sf_dir, c.mentions_once(spark, sf_dir)).select(F.col("node").alias("doc_id"), F.round("rank", 9).alias("rank"))


@c.query()
def linked_route(spark, sf_dir):
    """The two documents of each query whose matched names and rank over the links weigh most."""
    m = c.mentions_once(spark, sf_dir)
    found = c.matched(spark, sf_dir, m)
    scored = graph.seeded_documents(found, m, document_ranks(spark, sf_dir, m))
    return retrieval.top_k(scored.select("query_id", F.col("doc_id").alias("id"), "score"), 2).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# The words around what a route tells about itself.
ROUTE_ID, ROUTE_TITLE, ROUTE_SCORE = "linearrag-route", "LinearRAG hierarchy route", 2.0
ROUTE_TEXT = ("Matched hierarchy groups: ", "Matched entities: ", "none")


def route_contexts(asked: DataFrame, matched: DataFrame, groups: DataFrame, graph_name: str, most_groups: int = 4, most_entities: int = 6) -> DataFrame:
    """(query_id, id, title, text, score): for each query (query_id, terms) with terms, a context that tells what it matched.

    Groups (group_key) that a term names come first, in their order, then the first words of matched entities (query_id, entity, rank).
    """
    by_term = asked.select("query_id", F.explode("terms").alias("group_key")).join(groups.select("group_key").distinct(), "group_key").select("query_id", F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("r"), F.col("group_key").alias("g")).alias("x"))
    by_entity = matched.select("query_id", F.struct(F.lit(1).alias("p"), F.col("rank").cast("long").alias("r"), graph.group_key(F.col("entity")).alias("g")).alias("x"))
    ordered = by_term.unionByName(by_entity).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # terms of a query, and six entities
    names = matched.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("e"))
    listed = lambda xs, n: F.when(F.size(xs) > 0, F.array_join(F.slice(xs, 1, n), ", ")).otherwise(ROUTE_TEXT[2])
    rows = asked.where(F.size("terms") > 0).select("query_id").join(ordered, "query_id", "left").join(names, "query_id", "left")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.array_distinct(F.transform("x", lambda x: x["g"])), none)
    text = F.concat(F.lit(ROUTE_TEXT[0]), listed(own, most_groups), F.lit(". " + ROUTE_TEXT[1]), listed(F.coalesce(F.transform("e", lambda x: x["entity"]), none), most_entities), F.lit("."))
    return rows.select("query_id", F.lit(f"{graph_name}:{ROUTE_ID}").alias("id"), F.lit(ROUTE_TITLE).alias("title"), text.alias("text"), F.lit(ROUTE_SCORE).alias("score"))


@c.query(
    f"""WITH {c.MATCHED}, gk1 AS (SELECT DISTINCT split_part(entity, ' ', 1) AS g FROM m), og AS (SELECT query_id, 0 AS p, 0 AS r, t AS g FROM q JOIN gk1 ON t = g UNION ALL SELECT query_id, 1, rank, split_part(entity, ' ', 1) FROM matched),
od AS (SELECT query_id, g, min((p, r, g)) AS o FROM og GROUP BY 1, 2), ol AS (SELECT query_id, list(g ORDER BY o)[1:4] AS gs FROM od GROUP BY 1), el AS (SELECT query_id, list(entity ORDER BY rank)[1:6] AS es FROM matched GROUP BY 1)
SELECT a.query_id, 'documents:linearrag-route' AS id, 2.0::DOUBLE AS score, 'Matched hierarchy groups: ' || coalesce(array_to_string(gs, ', '), 'none') || '. Matched entities: ' || coalesce(array_to_string(es, ', '), 'none') || '.' AS text FROM (SELECT DISTINCT query_id FROM q) a LEFT JOIN ol USING (query_id) LEFT JOIN el USING (query_id)"""
)
def linear_route_context(spark, sf_dir):
    m = c.mentions_once(spark, sf_dir)
    groups = m.select(graph.group_key(F.col("entity")).alias("group_key"))
    return route_contexts(c.asked_terms(spark, sf_dir), c.matched(spark, sf_dir, m), groups, "documents").select("query_id", "id", "text", "score")
