"""Queries over chunk variants and records that link to one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T
from sparkwell.operators import chunking, ingest, retrieval, variants
from sparkwell.plans import records


def docs(spark, sf_dir):
    return c.read(spark, sf_dir, "documents")


@c.query()
def chunk_units(spark, sf_dir):
    """Packed paragraphs and lines."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.unit_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@c.query()
def chunk_sentences(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("chunk_index", "x"))
    return rows.select("doc_id", "chunk_index", F.col("x.text").alias("chunk"), F.size("x.sentence_texts").alias("n_sentences"))


@c.query()
def chunk_serialised(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.serialised_groups(F.col("source"), F.col("text"))).alias("chunk_index", "chunk"))


@c.query()
def request_batches(spark, sf_dir):
    return chunking.request_batches(docs(spark, sf_dir), "doc_id", "text").select(F.size("ids").alias("n"), "n_chars")


@c.query(
    f"""WITH t AS (SELECT doc_id, {c.STRIP.format("text")} AS t FROM documents), w AS (SELECT doc_id, unnest(CASE WHEN length(t) > 8000 THEN list_filter(list_transform(range(0, length(t), 8000), lambda i: {c.STRIP.format("substr(t, CAST(i + 1 AS BIGINT), 8000)")}), lambda x: x <> '') WHEN t <> '' THEN [t] ELSE [] END) AS chunk FROM t)
SELECT doc_id, md5(chunk) AS chunk_md5, length(chunk) AS n FROM w"""
)
def oversize_split(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(chunking.oversize_split(F.col("text"))).alias("chunk"))
    return rows.select("doc_id", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("n"))


@c.query(
    f"""WITH {c.HASHED}, e AS (SELECT doc_id, chunk_index, hash_id, {c.SENTENCES.format("chunk")} AS ss FROM firsts), s AS (SELECT doc_id, chunk_index, hash_id AS parent_id, unnest(range(len(ss))) AS i, unnest(ss) AS text FROM e)
SELECT doc_id, 'chunk' AS record_type, chunk_index, CAST(NULL AS INTEGER) AS sentence_index, hash_id, CAST(NULL AS VARCHAR) AS parent_id FROM firsts
UNION ALL SELECT doc_id, 'sentence', chunk_index, CAST(i AS INTEGER), sha256(parent_id || chr(10) || i || chr(10) || {c.SQUEEZE.format("text")}), parent_id FROM s"""
)
def hierarchical_records(spark, sf_dir):
    return chunking.hierarchical(ingest.hashed_chunks(docs(spark, sf_dir))).select("doc_id", "record_type", "chunk_index", "sentence_index", "hash_id", "parent_id")


LINKED = f"""{c.HASHED}, p0 AS (SELECT doc_id, CAST(chunk_index // 4 + 1 AS BIGINT) AS page_number, flatten(list({c.SENTENCES.format("chunk")} ORDER BY chunk_index)) AS ss FROM chunks GROUP BY 1, 2),
p1 AS (SELECT doc_id, page_number, substr(array_to_string(ss[1:4], ' '), 1, 800) AS page FROM p0 WHERE len(ss) > 0),
k0 AS (SELECT doc_id, chunk_index, hash_id, chunk, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 4 + 1 AS page_number FROM firsts),
linked AS (SELECT p1.doc_id, p1.page_number, sha256(p1.doc_id || ':page:' || p1.page_number || chr(10) || {c.SQUEEZE.format("any_value(page)")}) AS hash_id, list(k0.hash_id ORDER BY chunk_index) AS kids FROM p1 JOIN k0 ON k0.doc_id = p1.doc_id AND k0.page_number = p1.page_number GROUP BY p1.doc_id, p1.page_number)"""


def linked(spark, sf_dir):
    rows = docs(spark, sf_dir)
    kept = ingest.hashed_chunks(rows)
    return chunking.linked_pages(kept, variants.pages(ingest.chunks(rows))), kept


@c.query(f"WITH {LINKED} SELECT doc_id, page_number, hash_id, array_to_string(kids, ' ') AS children FROM linked")
def linked_pages(spark, sf_dir):
    return linked(spark, sf_dir)[0].select("doc_id", "page_number", "hash_id", F.array_join("child_hash_ids", " ").alias("children"))


@c.query(f"WITH {LINKED}, e AS (SELECT doc_id, page_number, unnest(range(len(kids))) AS child, unnest(kids) AS hash_id FROM linked) SELECT e.doc_id, page_number, CAST(child AS INTEGER) AS child, e.hash_id, chunk FROM e JOIN firsts USING (hash_id)")
def page_children(spark, sf_dir):
    """Every page, read as its chunks."""
    pages, kept = linked(spark, sf_dir)
    return chunking.children(pages, kept, ["doc_id", "page_number"])


TREE = f"""{c.HASHED}, tn AS (SELECT doc_id, CAST(chunk_index // 4 AS BIGINT) AS node, list(hash_id ORDER BY chunk_index) AS kids, coalesce(string_agg(({c.SENTENCES.format("chunk")})[1], ' ' ORDER BY chunk_index), '') AS summary FROM firsts GROUP BY 1, 2),
th AS (SELECT *, sha256(doc_id || ':node:' || node || chr(10) || {c.SQUEEZE.format("summary")}) AS hash_id FROM tn)"""


@c.query(
    f"""WITH {TREE} SELECT doc_id, 'summary' AS record_type, node, hash_id, CAST(NULL AS VARCHAR) AS parent_id, len(kids) AS n_children FROM th
UNION ALL SELECT f.doc_id, 'leaf', th.node, f.hash_id, th.hash_id, 0 FROM firsts f JOIN th ON th.doc_id = f.doc_id AND th.node = f.chunk_index // 4"""
)
def tree_records(spark, sf_dir):
    """A tree of summaries with its leaves, each of which names the summary above it."""
    rows = variants.tree_records(ingest.hashed_chunks(docs(spark, sf_dir)))
    return rows.select("doc_id", "record_type", "node", "hash_id", "parent_id", F.col("n_children").cast("long").alias("n_children"))


@c.query(
    f"""WITH tv AS (FROM ({c.ORACLE["table_view_records"]})), rw AS (SELECT struct_pack(doc_id := doc_id, row_index := row_index) AS rid, content FROM tv WHERE view = 'table_row'), {c.bm25_sql("rw", "rid", "content", "m")}, {c.top_sql("m", 20, "t")},
g AS (SELECT query_id, t.id.doc_id AS doc_id, min(rank) AS rank, list(content ORDER BY rank)[1:4] AS r FROM t JOIN rw ON rid = t.id GROUP BY 1, 2) SELECT query_id, g.doc_id, rank, content, array_to_string(r, chr(10)) AS rows FROM g JOIN tv ON tv.doc_id = g.doc_id AND view = 'table_summary'"""
)
def parent_collapse(spark, sf_dir):
    """Rows of tables are found, their tables are shown."""
    views = records.table_views(docs(spark, sf_dir), "doc_id", "source", "text")
    rows = views.where("view = 'table_row'").select(F.struct("doc_id", "row_index").alias("rid"), "content")
    hits = retrieval.bm25_top_k(c.questions(spark, sf_dir), rows, "rid", "content", 20)
    found = hits.join(rows, F.col("id") == F.col("rid")).select("query_id", F.col("id.doc_id").alias("doc_id"), "rank", F.col("content").alias("text"))
    return chunking.collapsed(found, views.where("view = 'table_summary'").select("doc_id", "content"))


@c.query(
    f"""WITH p AS (SELECT role || ' ' || conv_id % 10 AS title, conv_id, turn, {c.SENTENCES.format("text")} AS ss FROM conversations), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY title ORDER BY conv_id, turn) = 1)
SELECT title, array_to_string(ss, ' ') AS text FROM f"""
)
def paragraph_dedupe(spark, sf_dir):
    """Roles by conversation number stand in for titles."""
    rows = c.read(spark, sf_dir, "conversations").select(F.concat("role", F.lit(" "), (F.col("conv_id") % 10).cast("string")).alias("title"), "conv_id", "turn", T.sentences(F.col("text")).alias("ss"))
    return chunking.first_of_title(rows, "title", ["conv_id", "turn"], "ss")
