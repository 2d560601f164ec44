"""Every query by name, and the SQL that states the same result.

Queries read whole tables.  `documents` is the corpus, `benchmark` the questions, `embeddings` the vectors (equal labels are
relevant; every hundredth vector is a query), `pages` the web, `conversations` the chats; `events` and the star schema stand
in for run logs and tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell.functions import text as T
from sparkwell.operators import fusion, graph, ingest, metrics, policy, retrieval, variants
from sparkwell.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Parts of the SQL that many queries share.
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CHUNKS = f"""c0 AS (SELECT doc_id, source, unnest(range(0, length(text), 448)) AS s, text FROM documents WHERE length(text) > 0),
c1 AS (SELECT doc_id, source, s, {STRIP.format("substr(text, s + 1, 512)")} AS chunk FROM c0),
chunks AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, chunk FROM c1 WHERE chunk <> '')"""
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TERMS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"
PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]"""
ANSWER = f"list_filter(string_split(regexp_replace(regexp_replace(lower({{}}), '{PUNCT}', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
SCORED = f"list_filter(string_split(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+|[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '{PUNCT}', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({{}}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+|' || chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


def bm25_sql(docs: str, ident: str, text: str, name: str, queries: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    """CTEs that end in `name` (query_id, id, score, matched)."""
    n = name
    return f"""{n}w AS (SELECT {ident} AS id, {TOKENS.format(text)} AS w FROM {docs}),
{n}n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM {n}w),
{n}e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM {n}w),
{n}tf AS (SELECT id, dl, term, count(*) AS tf FROM {n}e GROUP BY ALL),
{n}df AS (SELECT term, count(*) AS df FROM {n}tf GROUP BY term),
{n}q AS (SELECT query_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM {queries}),
{n} AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score, count(*) AS matched
  FROM {n}q JOIN {n}tf USING (term) JOIN {n}df USING (term), {n}n GROUP BY query_id, id)"""


def top_sql(rows: str, k: int, name: str, tie: str = "id") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {tie}) AS rank FROM {rows} QUALIFY rank <= {k})"


DOC_BM25 = bm25_sql("documents", "doc_id", "text", "m")


def doc_hits(spark, sf_dir, k: int = 20) -> DataFrame:
    return retrieval.bm25_top_k(questions(spark, sf_dir), read(spark, sf_dir, "documents"), "doc_id", "text", k)


# Text and ingest


@query(
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), url) AS title,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages"""
)
def html_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html"), F.col("url")).alias("title"), T.html_text(F.col("html")).alias("body"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk FROM chunks")
def chunk_window(spark, sf_dir):
    return ingest.chunks(read(spark, sf_dir, "documents"))


HASHED = f"""{CHUNKS}, hashed AS (SELECT doc_id, chunk_index, chunk, sha256(CAST(doc_id AS VARCHAR) || chr(10) || {SQUEEZE.format("chunk")}) AS hash_id FROM chunks),
firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY hash_id ORDER BY chunk_index, doc_id, chunk) = 1)"""


@query(f"WITH {HASHED} SELECT doc_id, chunk_index, chunk, hash_id FROM firsts")
def chunk_hash_dedupe(spark, sf_dir):
    return ingest.hashed_chunks(read(spark, sf_dir, "documents"))


@query(f"WITH {HASHED}, old AS (SELECT hash_id FROM firsts JOIN documents USING (doc_id) WHERE source = 'src0') SELECT hash_id, doc_id, chunk_index FROM firsts WHERE hash_id NOT IN (SELECT hash_id FROM old)")
def anti_join_new_chunks(spark, sf_dir):
    """What an index of one source's chunks lacks."""
    docs = read(spark, sf_dir, "documents")
    return ingest.absent(ingest.hashed_chunks(docs), ingest.hashed_chunks(docs.where("source = 'src0'"))).select("hash_id", "doc_id", "chunk_index")


@query(f"WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents) SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sentence_index, unnest(ss) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query(
    f"""WITH k AS (SELECT doc_id, CASE WHEN trim(text) <> '' THEN sha256(source || chr(10) || {SQUEEZE.format("text")}) END AS hash_id,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256(source || chr(10) || {SQUEEZE.format("text")}) END AS old FROM documents)
SELECT doc_id, hash_id, CASE WHEN hash_id IS NULL THEN 'skip' WHEN row_number() OVER (PARTITION BY hash_id ORDER BY doc_id) > 1 THEN 'delete' WHEN old IS NOT DISTINCT FROM hash_id THEN 'keep' ELSE 'update' END AS action FROM k"""
)
def hash_backfill_plan(spark, sf_dir):
    """A third of the rows lack their hash; later duplicates within a source go."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.withColumn("old", F.when(F.col("doc_id") % 3 != 0, ingest.chunk_hash(F.col("source"), F.col("text"))))
    return ingest.backfill_plan(rows, F.col("source"), "text", "old", ["doc_id"]).select("doc_id", "hash_id", "action")


@query("SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END, CASE WHEN url <> '' THEN 'web:' || url END, 'none') AS hash_key FROM pages")
def doc_hash_key(spark, sf_dir):
    none = F.lit(None).cast("string")
    key = ingest.document_key(F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), F.lit("web"), F.col("url"), none, F.lit("none"))
    return read(spark, sf_dir, "pages").select("page_id", key.alias("hash_key"))


@query("SELECT c_custkey, concat_ws(' | ', 'c_name: ' || nullif(c_name, ''), 'c_mktsegment: ' || nullif(c_mktsegment, ''), 'n_name: ' || nullif(n_name, '')) AS row_text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def table_linearize(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ingest.linearize(rows, "c_custkey", ["c_name", "c_mktsegment", "n_name"])


@query(
    """WITH l AS (SELECT l_orderkey, string_agg('line: ' || l_linenumber || ' | part: ' || l_partkey || ' | quantity: ' || CAST(l_quantity AS BIGINT), chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS rows FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'Order ' || o_orderkey || '.' || chr(10) || chr(10) || rows || chr(10) || chr(10) || 'Priority ' || o_orderpriority AS text FROM orders JOIN l ON l_orderkey = o_orderkey"""
)
def table_document(spark, sf_dir):
    """An order's lines as a table within its text; its status, a letter, is noise."""
    row = F.struct("l_linenumber", "l_partkey", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cells = F.transform("rows", lambda r: F.array(r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_quantity"].cast("bigint").cast("string")))
    table = F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("quantity"))), cells)
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    before = F.array(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(".")), F.substring("o_orderstatus", 1, 1))
    return orders.select("o_orderkey", ingest.document_with_table(before, table, F.array(F.concat(F.lit("Priority "), "o_orderpriority"))).alias("text"))


@query(f"WITH {CHUNKS} SELECT doc_id, string_agg(chunk, chr(10) ORDER BY chunk_index, chunk) AS text, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def documents_from_chunks(spark, sf_dir):
    return ingest.documents_from_chunks(ingest.chunks(read(spark, sf_dir, "documents")))


# Retrieval

COSINE = "c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"


def vector_hits(spark, sf_dir, k):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return retrieval.cosine_top_k(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), v, k)


@query(f"WITH {COSINE}, {top_sql('c', 10, 't')} SELECT query_id, id, rank, round(score, 6) AS score FROM t")
def cosine_topk(spark, sf_dir):
    return vector_hits(spark, sf_dir, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


CHUNK_BM25 = f"{CHUNKS}, ids AS (SELECT *, struct_pack(doc_id := doc_id, chunk_index := chunk_index) AS cid FROM chunks), {bm25_sql('ids', 'cid', 'chunk', 'm')}"


def chunk_hits(spark, sf_dir, k):
    """(query_id, doc_id, chunk_index, score, rank)."""
    rows = ingest.chunks(read(spark, sf_dir, "documents")).withColumn("cid", F.struct("doc_id", "chunk_index"))
    return retrieval.bm25_top_k(questions(spark, sf_dir), rows, "cid", "chunk", k).select("query_id", "id.doc_id", "id.chunk_index", "score", "rank")


@query(f"WITH {CHUNK_BM25}, {top_sql('m', 5, 't')} SELECT query_id, id.doc_id AS doc_id, id.chunk_index AS chunk_index, rank, round(score, 6) AS score FROM t")
def bm25_topk(spark, sf_dir):
    return chunk_hits(spark, sf_dir, 5).select("query_id", "doc_id", "chunk_index", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {bm25_sql("documents", "doc_id", "text", "m")}, h AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), {bm25_sql("h", "doc_id", "title", "y")},
b AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, 3 * score AS score FROM y UNION ALL SELECT query_id, id, 2 * score FROM m) GROUP BY ALL), {top_sql("b", 5, "t")}
SELECT query_id, id, rank, round(score, 6) AS score FROM t"""
)
def bm25_fields_boosted(spark, sf_dir):
    """The first line as title, boosted 3; the text, boosted 2; the best field counts."""
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    title = retrieval.bm25_top_k(q, docs.select("doc_id", F.split("text", "\n")[0].alias("title")), "doc_id", "title", 5)
    hits = retrieval.top_k(retrieval.best_field([(title, 3.0), (retrieval.bm25_top_k(q, docs, "doc_id", "text", 5), 2.0)]), 5)
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {DOC_BM25}, n AS (SELECT query_id, count(*) AS n FROM mq GROUP BY query_id), a AS (SELECT m.* FROM m JOIN n USING (query_id) WHERE matched = n), {top_sql('a', 10, 't')} SELECT query_id, id, rank FROM t")
def keyword_and(spark, sf_dir):
    return retrieval.bm25_top_k(questions(spark, sf_dir), read(spark, sf_dir, "documents"), "doc_id", "text", 10, every=True).select("query_id", "id", "rank")


@query(
    f"""WITH {CHUNK_BM25}, {top_sql("m", 5, "t")}, a AS (SELECT DISTINCT query_id, id.doc_id AS doc_id, id.chunk_index + unnest([-1, 0, 1]) AS chunk_index FROM t WHERE rank <= 2)
SELECT query_id, doc_id, a.chunk_index, chunk FROM a JOIN chunks USING (doc_id, chunk_index)"""
)
def neighbor_expand(spark, sf_dir):
    return retrieval.neighbours(chunk_hits(spark, sf_dir, 5), ingest.chunks(read(spark, sf_dir, "documents")))


@query(
    f"""WITH {CHUNK_BM25}, {top_sql("m", 20, "t")}, n AS (SELECT query_id, id.doc_id AS doc_id, id.chunk_index AS chunk_index, rank, row_number() OVER (PARTITION BY query_id, id.doc_id ORDER BY rank) > 2 AS late FROM t)
SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late, rank) <= 5"""
)
def diversify_topk(spark, sf_dir):
    return retrieval.diversify(chunk_hits(spark, sf_dir, 20), 5).select("query_id", "doc_id", "chunk_index", "rank")


@query(f"WITH scope AS (SELECT * FROM documents WHERE source LIKE 'src1%'), {bm25_sql('scope', 'doc_id', 'text', 'm')}, {top_sql('m', 5, 't')} SELECT query_id, id, rank, round(score, 6) AS score FROM t")
def scope_filtered_topk(spark, sf_dir):
    """The scope's filter stands below the top k, so k hits come back where the scope has them."""
    docs = read(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    return retrieval.bm25_top_k(questions(spark, sf_dir), docs, "doc_id", "text", 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# Fusion and reranking

LISTS = f"WITH {DOC_BM25}, {top_sql('m', 20, 'd')}, h AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), {bm25_sql('h', 'doc_id', 'title', 'y')}, {top_sql('y', 20, 'l')}"


def two_lists(spark, sf_dir):
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    first_lines = docs.select("doc_id", F.split("text", "\n")[0].alias("title"))
    return doc_hits(spark, sf_dir), retrieval.bm25_top_k(q, first_lines, "doc_id", "title", 20)


def fuse_sql(k: int, w: tuple[str, str] = ("1.0", "1.0")) -> str:
    return f"""u AS (SELECT query_id, id, 0 AS list, rank, score, {w[0]} / (60 + rank) AS w FROM d UNION ALL SELECT query_id, id, 1, rank, score, {w[1]} / (60 + rank) FROM l),
f AS (SELECT query_id, id, sum(w) AS rrf, min((list, rank, score)) AS first FROM u GROUP BY ALL),
g AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, round(first[3], 9) DESC, first[1], first[2], id) AS rank FROM f QUALIFY rank <= {k})"""


@query(f"{LISTS}, {fuse_sql(10)} SELECT query_id, id, rank, round(rrf, 9) AS rrf FROM g")
def rrf_fuse(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    return fusion.rrf([(a, 1.0), (b, 1.0)], 10).select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"))


@query(f"{LISTS}, {fuse_sql(10, ('1.0', '3.0'))} SELECT query_id, id, rank, round(rrf, 9) AS rrf FROM g")
def rrf_weighted(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    return fusion.rrf([(a, 1.0), (b, 3.0)], 10).select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"))


@query(
    f"""{LISTS}, {fuse_sql(10)}, z AS (SELECT query_id, id, 0 AS p, rank FROM l WHERE rank <= 2 UNION ALL SELECT query_id, id, 1, rank FROM g),
o AS (SELECT query_id, id, min((p, rank)) AS pl FROM z GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pl, id) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pl, id) <= 8"""
)
def sparse_anchor_merge(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    return fusion.anchors_first(b, fusion.rrf([(a, 1.0), (b, 1.0)], 10), 8)


def contexts(spark, sf_dir, k=10):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = questions(spark, sf_dir).withColumnRenamed("text", "query")
    return doc_hits(spark, sf_dir, k).join(docs, "id").join(q, "query_id").select("query_id", "query", "id", "text", "score", "rank")


CONTEXTS = f"WITH {DOC_BM25}, {top_sql('m', 10, 't')}, x AS (SELECT t.query_id, b.text AS query, t.id, d.text, t.score, t.rank FROM t JOIN documents d ON d.doc_id = t.id JOIN benchmark b ON b.item_id = t.query_id)"


@query(
    f"""{CONTEXTS}, s AS (SELECT query_id, id, score, {TERMS.format("query")} AS terms, {SENTENCES.format("text")}[1:6] AS ss FROM x),
b AS (SELECT query_id, id, score, coalesce(list_max(list_transform(ss, lambda s: len(list_filter(terms, lambda t: contains(lower(s), t))) / greatest(len(terms), 1))), -1.0) AS best FROM s)
SELECT query_id, id, round(best, 6) AS best, row_number() OVER (PARTITION BY query_id ORDER BY round(best, 9) DESC, round(score, 9) DESC, id) AS rank FROM b"""
)
def sentence_rerank(spark, sf_dir):
    return fusion.sentence_rerank(contexts(spark, sf_dir)).select("query_id", "id", F.round("best", 6).alias("best"), "rank")


@query(
    f"""{CONTEXTS}, k AS (SELECT query_id, id, rank, {STRIP.format("text")} AS t, split_part(text, chr(10), 1) AS title FROM x QUALIFY row_number() OVER (PARTITION BY query_id, lower({SQUEEZE.format("text")}) ORDER BY rank) = 1)
SELECT query_id, id, rank, CASE WHEN title <> '' AND starts_with(t, title) THEN regexp_replace(substr(t, length(title) + 1), '^[ :\\n\\-]+', '') ELSE t END AS text FROM k"""
)
def context_dedupe(spark, sf_dir):
    """The first line stands for the title."""
    rows = contexts(spark, sf_dir).withColumn("title", F.split("text", "\n")[0])
    return fusion.compact_contexts(rows).select("query_id", "id", "rank", "text")


@query(
    f"""{CONTEXTS}, s AS (SELECT query_id, id, score, {TERMS.format("query")} AS terms, {SENTENCES.format("text")} AS ss FROM x),
e AS (SELECT query_id, id, score, terms, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM s),
w AS (SELECT query_id, id, s, i, list_sum(list_transform(list_filter(terms, lambda t: contains(lower(s), t)), lambda t: greatest(length(t), 3))) AS w FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY w DESC, i) AS n FROM w WHERE w > 0 QUALIFY n <= 2)
SELECT x.query_id, x.id, coalesce(string_agg(k.s, ' ' ORDER BY k.n), '') AS snippet, CAST(coalesce(sum(k.w), 0) AS BIGINT) AS gain FROM x LEFT JOIN k ON k.query_id = x.query_id AND k.id = x.id GROUP BY ALL"""
)
def snippet_rescore(spark, sf_dir):
    rows = contexts(spark, sf_dir)
    return fusion.snippets(rows.withColumn("score", F.lit(0))).select("query_id", "id", "snippet", F.col("score").cast("bigint").alias("gain"))


# Metrics: neighbouring turns of a conversation stand in for predictions and gold answers.

PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def pairs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("pred"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(b, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, array_to_string({ANSWER.format('text')}, ' ') AS answer FROM conversations")
def normalize_answer(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("answer"))


def overlap_sql(tokens: str) -> str:
    """CTEs that end in o: the pairs with their tokens a and b and the size c of the multiset intersection."""
    return f"""{PAIRS}, t AS (SELECT conv_id, turn, pred, gold, {tokens.format("pred")} AS a, {tokens.format("gold")} AS b FROM p),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda v: least(len(list_filter(a, lambda x: x = v)), len(list_filter(b, lambda x: x = v))))), 0) AS c FROM t)"""


F1 = overlap_sql(SCORED)
STRICT = f"""{overlap_sql(ANSWER)}, z0 AS (SELECT *, array_to_string(a, ' ') AS na, array_to_string(b, ' ') AS nb, len(list_distinct(list_intersect(a, b))) AS h, len(list_distinct(a)) AS n, len(list_distinct(b)) AS m FROM o),
z1 AS (SELECT *, CAST(na = nb AS DOUBLE) AS em, c = 0 OR (na <> nb AND (na IN ('yes', 'no', 'noanswer') OR nb IN ('yes', 'no', 'noanswer'))) AS none FROM z0)"""


@query(f"WITH {STRICT} SELECT conv_id, turn, em, round(CASE WHEN none THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END, 6) AS f1 FROM z1")
def strict_f1(spark, sf_dir):
    """Exact match and F1 of short answers."""
    em, _, _, f1 = metrics.strict_scores(F.col("pred"), F.col("gold"))
    return pairs(spark, sf_dir).select("conv_id", "turn", em.alias("em"), F.round(f1, 6).alias("f1"))


@query(f"WITH {F1} SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END, 6) AS f1 FROM o")
def token_f1(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_scores(F.col("pred"), F.col("gold"))[2], 6).alias("f1"))


FACTS = "f AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0)) AS p, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 1)) AS g FROM orders GROUP BY 1)"
SCORES = "s AS (SELECT k, len(list_intersect(coalesce(p, []), coalesce(g, []))) AS h, len(coalesce(p, [])) AS n, len(coalesce(g, [])) AS m FROM f), r AS (SELECT k, h, n, m, CASE WHEN n = 0 THEN 0.0 ELSE h / n END AS pr, CASE WHEN m = 0 THEN 0.0 ELSE h / m END AS rc FROM s)"


def facts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("p"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority"))).alias("g"))


@query(f"WITH {FACTS}, {SCORES} SELECT k, round(pr, 6) AS sp_precision, round(rc, 6) AS sp_recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS sp_f1, CAST(h = n AND h = m AS DOUBLE) AS sp_em FROM r")
def sp_f1(spark, sf_dir):
    s = metrics.fact_scores(F.col("p"), F.col("g"))
    return facts(spark, sf_dir).select("k", *(F.round(c, 6).alias(n) for c, n in zip(s[:3], ("sp_precision", "sp_recall", "sp_f1"))), s[3].alias("sp_em"))


@query(
    f"""WITH {STRICT}, z AS (SELECT conv_id, turn, em * CAST(h = n AND h = m AS DOUBLE) AS joint_em, CASE WHEN none OR n = 0 THEN 0.0 ELSE c / len(a) * h / n END AS p, CASE WHEN none OR m = 0 THEN 0.0 ELSE c / len(b) * h / m END AS r FROM z1)
SELECT conv_id, turn, joint_em, round(p, 6) AS joint_precision, round(r, 6) AS joint_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS joint_f1 FROM z"""
)
def joint_metrics(spark, sf_dir):
    """Scores of short answers times scores of the distinct tokens as facts."""
    em, p, r, _ = metrics.strict_scores(F.col("pred"), F.col("gold"))
    fp, fr, _, fem = metrics.fact_scores(T.answer_tokens(F.col("pred")), T.answer_tokens(F.col("gold")))
    rows = pairs(spark, sf_dir).select("conv_id", "turn", (em * fem).alias("joint_em"), (p * fp).alias("p"), (r * fr).alias("r"))
    return rows.select("conv_id", "turn", "joint_em", F.round("p", 6).alias("joint_precision"), F.round("r", 6).alias("joint_recall"), F.round(metrics.ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("joint_f1"))


@query()
def rouge_l(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("pred"), F.col("gold")), 6).alias("rouge_l"))


@query(
    f"""WITH {COSINE}, {top_sql("c", 10, "t")}, gold AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), s AS (SELECT gold.query_id, count(*) FILTER (WHERE rank <= 5) AS h, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5) AS d FROM gold JOIN t ON t.query_id = gold.query_id AND t.id = gold.id GROUP BY 1)
SELECT n.query_id, round(coalesce(h / n, 0), 6) AS recall_5, round(coalesce(d / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_5 FROM n LEFT JOIN s USING (query_id)"""
)
def recall_ndcg(spark, sf_dir):
    """Relevant vectors are counted by label, not listed."""
    v = read(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    n = asked.join(v.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", "n")
    hits = metrics.unique_ranks(vector_hits(spark, sf_dir, 10), 10).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return metrics.scores_of_ranks(hits.join(asked, ["query_id", "label"]), n).select("query_id", F.round("recall_5", 6).alias("recall_5"), F.round("ndcg_5", 6).alias("ndcg_5"))


@query(
    f"""WITH n AS (SELECT conv_id, turn, {SQUEEZE.format(f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{chr(92)}b(a|an|the){chr(92)}b', ' ', 'g'), '{PUNCT.format()}', '', 'g')")} AS t FROM conversations)
SELECT conv_id, turn, t = '' OR {" OR ".join(f"contains(t, '{m}')" for m in T.ABSTENTIONS)} AS abstains FROM n"""
)
def abstention(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.abstains(F.col("text")).alias("abstains"))


@query(
    r"""WITH x AS (SELECT o_orderkey, TRY_CAST(regexp_extract(regexp_replace('$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',5%', '[,$%]', '', 'g'), '-?\d+\.?\d*') AS DOUBLE) AS p, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 1.0 ELSE 0.1 END AS g FROM orders)
SELECT o_orderkey, p, abs(p - g) <= greatest(1e-3 * greatest(abs(p), abs(g)), 1e-6) OR (abs(g) < 10 AND abs(p - g * 100) <= greatest(1e-3 * greatest(abs(p), abs(g * 100)), 1e-6)) OR (abs(p) < 10 AND abs(p * 100 - g) <= greatest(1e-3 * greatest(abs(p * 100), abs(g)), 1e-6)) AS ok FROM x"""
)
def finqa_match(spark, sf_dir):
    said = F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(",5%"))
    gold = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 10.0).when(F.col("o_orderkey") % 3 == 1, 1.0).otherwise(0.1)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", T.number_in(said).alias("p"), gold.alias("g"))
    return rows.select("o_orderkey", "p", T.numbers_match(F.col("p"), F.col("g")).alias("ok"))


# Users stand in for runs, each with a model's dated name or one that no price list has.
MODELS = ("gpt-5-mini", "gpt-5", "gpt-4.1-mini-2025-04-14", "claude-sonnet-4-5", "unlisted")
USAGE = f"u AS (SELECT [{', '.join(f"'{m}'" for m in MODELS)}][user_id % 5 + 1] AS model, CAST(sum(user_id) AS BIGINT) AS n_in, CAST(sum(user_id // 2) AS BIGINT) AS n_cached, count(*) AS n_out FROM events GROUP BY 1)"


def usage(spark, sf_dir):
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").groupBy(model.alias("model")).agg(F.sum("user_id").alias("n_in"), F.sum(F.expr("user_id div 2")).alias("n_cached"), F.count("*").alias("n_out"))


@query(
    f"""WITH {USAGE}, prices(prefix, p_in, p_cached, p_out) AS (VALUES {", ".join(map(str, metrics.PRICES))}),
b AS (SELECT model, max((length(prefix), p_in, p_cached, p_out)) AS b FROM (SELECT DISTINCT model FROM u) JOIN prices ON starts_with(model, prefix) GROUP BY 1)
SELECT model, n_in, round(((n_in - n_cached) * CAST(coalesce(b[2], 0.25) AS DOUBLE) + n_cached * CAST(coalesce(b[3], 0.025) AS DOUBLE) + n_out * CAST(coalesce(b[4], 2.0) AS DOUBLE)) / 1e6, 6) AS cost FROM u LEFT JOIN b USING (model)"""
)
def cost_by_model(spark, sf_dir):
    return metrics.priced(usage(spark, sf_dir), metrics.price_table(spark)).select("model", "n_in", F.round("cost", 6).alias("cost"))


# Reports


@query("SELECT d.lang, d.source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY CUBE (d.lang, d.source)")
def metrics_cube(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.cube("lang", "source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))


@query("WITH r AS (SELECT unnest(list_distinct(['all', 'lang=' || d.lang, 'source=' || d.source])) AS grp, quality FROM labels l JOIN documents d USING (doc_id)) SELECT grp, round(avg(quality), 6) AS quality, count(*) AS n FROM r GROUP BY 1")
def group_label_means(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    labels = F.array_distinct(F.array(F.lit("all"), F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source")))
    return rows.select(F.explode(labels).alias("grp"), "quality").groupBy("grp").agg(F.round(F.avg("quality"), 6).alias("quality"), F.count("*").alias("n"))


@query("WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, turn, role FROM conversations JOIN l USING (conv_id) WHERE turn < last AND role IN ('user', 'assistant')")
def conversation_history(spark, sf_dir):
    """What stands before a conversation's last question."""
    c = read(spark, sf_dir, "conversations")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(last, "conv_id").where("turn < last and role in ('user', 'assistant')").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 10)")
def first_n_conversations(spark, sf_dir):
    """A report's first ten conversations."""
    c = read(spark, sf_dir, "conversations")
    return c.join(c.select("conv_id").distinct().orderBy("conv_id").limit(10), "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 25")
def per_variant_limit(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy("event_id")
    return read(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(order).alias("n")).where("n <= 25").drop("n")


@query("SELECT event_type AS decision, count(*) AS n, round(avg(value), 4) AS mean_value, round(avg(user_id), 4) AS mean_user, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def decision_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    per = e.groupBy(F.col("event_type").alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg("user_id"), 4).alias("mean_user"))
    total = e.agg(F.count("*").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("decision", "n", "mean_value", "mean_user", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # total: one row


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) // count(*) AS BIGINT) AS mean_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY 1")
def usage_summary(spark, sf_dir):
    """Integer averages, and the last known type of each user."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.expr("sum(event_id) div count(*)").alias("mean_id"), F.max_by("event_type", "event_id").alias("last_type"))


# Policies


@query(
    f"""{CONTEXTS}, xt AS (SELECT query_id, query, id, rank, coalesce(source, '') || ' ' || coalesce(x.text, '') AS text FROM x JOIN documents ON doc_id = id),
y AS (SELECT query_id, query, id, text, unnest(CASE WHEN rank % 3 = 0 THEN [(rank - 1) // 3, rank // 3] ELSE [(rank - 1) // 3] END) AS round FROM xt),
r AS (SELECT query_id, round, id, {TERMS.format("query")} AS terms, list_filter({TERMS.format("query")}, lambda t: contains(lower(text), t)) AS m, round = min(round) OVER (PARTITION BY query_id, id) AS new FROM y),
p AS (SELECT query_id, round, any_value(terms) AS terms, list_distinct(flatten(list(m))) AS m, count(*) FILTER (WHERE len(m) >= 2 AND new) AS s, count(*) FILTER (WHERE new) / count(*) AS novelty FROM r GROUP BY 1, 2),
c AS (SELECT a.query_id, a.round, any_value(a.terms) AS terms, any_value(a.novelty) AS novelty, len(list_distinct(flatten(list(b.m)))) AS seen, sum(b.s) AS supportive FROM p a JOIN p b ON a.query_id = b.query_id AND b.round <= a.round GROUP BY 1, 2),
v AS (SELECT query_id, round, CASE WHEN len(terms) > 0 THEN seen / len(terms) ELSE 0.0 END AS coverage, supportive, novelty FROM c)
SELECT query_id, CAST(round AS BIGINT) AS round, round(coverage, 6) AS coverage, CAST(supportive AS BIGINT) AS supportive, round(novelty, 6) AS novelty, round(greatest(coverage - coalesce(lag(coverage) OVER (PARTITION BY query_id ORDER BY round), 0), 0), 6) AS gain FROM v"""
)
def coverage_trace(spark, sf_dir):
    """The ten best contexts, titles and texts, in rounds of three; the last of a round comes again in the next.  The source stands for the title."""
    titles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    rank = F.col("rank").cast("long")
    rounds = F.when(rank % 3 == 0, F.array(F.expr("(cast(rank as bigint) - 1) div 3"), F.expr("cast(rank as bigint) div 3"))).otherwise(F.array(F.expr("(cast(rank as bigint) - 1) div 3")))
    rows = contexts(spark, sf_dir).join(titles, "id").select("query_id", F.explode(rounds).alias("round"), "id", T.query_terms(F.col("query")).alias("terms"), "title", "text")
    out = policy.trace(rows)
    return out.select("query_id", "round", F.round("coverage", 6).alias("coverage"), F.col("supportive").cast("bigint").alias("supportive"), F.round("novelty", 6).alias("novelty"), F.round("gain", 6).alias("gain"))


@query(
    f"""WITH t AS (FROM ({ORACLE["coverage_trace"]})) SELECT query_id, round, round >= 2 OR round(0.60 * coverage + 0.20 * least(supportive / 2, 1.0) + CASE WHEN round > 0 THEN 0.20 * (1 - novelty) ELSE 0 END, 6) >= round(0.55 * (1 - coverage) + 0.25 * gain + 0.20 * novelty - 0.15 * round, 6) AS stop FROM t"""
)
def trace_stop(spark, sf_dir):
    """After which round each question's trace says stop."""
    t = coverage_trace(spark, sf_dir)
    return t.select("query_id", "round", policy.should_stop(*(F.col(x) for x in ("coverage", "supportive", "novelty", "gain", "round")), digits=6).alias("stop"))


STOPS = "x AS (SELECT event_id, (event_id % 11) / 10 AS cov, event_id % 4 AS sup, (event_id % 5) / 4 AS nov, (event_id % 3) / 10 AS gain, event_id % 3 AS rnd FROM events)"


@query(
    f"""WITH {STOPS} SELECT event_id, rnd >= 2 OR round(0.60 * cov + 0.20 * least(sup / 2, 1.0) + CASE WHEN rnd > 0 THEN 0.20 * (1 - nov) ELSE 0 END, 9) >= round(0.55 * (1 - cov) + 0.25 * gain + 0.20 * nov - 0.15 * rnd, 9) AS stop FROM x"""
)
def continue_stop(spark, sf_dir):
    e = F.col("event_id")
    x = read(spark, sf_dir, "events").select("event_id", ((e % 11) / 10).alias("cov"), (e % 4).alias("sup"), ((e % 5) / 4).alias("nov"), ((e % 3) / 10).alias("gain"), (e % 3).alias("rnd"))
    return x.select("event_id", policy.should_stop(*(F.col(c) for c in ("cov", "sup", "nov", "gain", "rnd"))).alias("stop"))


@query(f"WITH {DOC_BM25}, {top_sql('m', 20, 't')} SELECT query_id, round(stddev_pop(score) / max(score), 6) AS qpp, round(stddev_pop(score) / max(score), 9) >= 0.08 AS accepted FROM t WHERE score > 0 AND rank <= 5 GROUP BY 1")
def qpp_dispersion(spark, sf_dir):
    return policy.dispersion(doc_hits(spark, sf_dir), 5).select("query_id", F.round("qpp", 6).alias("qpp"), (F.round("qpp", 9) >= 0.08).alias("accepted"))


@query(f"WITH {DOC_BM25}, {top_sql('m', 100, 't')} SELECT query_id, round(stddev_pop(score) / abs(avg(score)), 6) AS nqc, CASE WHEN round(stddev_pop(score) / abs(avg(score)), 9) >= 0.10 THEN 'fuse' ELSE 'retry' END AS route FROM t WHERE score > 0 GROUP BY 1")
def nqc_route(spark, sf_dir):
    return policy.dispersion(doc_hits(spark, sf_dir, 100), 100).select("query_id", F.round("nqc", 6).alias("nqc"), F.when(F.round("nqc", 9) >= 0.10, "fuse").otherwise("retry").alias("route"))


@query(
    f"""WITH {COSINE}, {top_sql("c", 10, "t")}, e AS (SELECT query_id, id, greatest(score - 1, 0) AS s, CAST(embedding AS DOUBLE[]) AS v FROM t JOIN embeddings ON vec_id = id),
p AS (SELECT a.query_id, list_reverse_sort(list(greatest(list_cosine_similarity(a.v, b.v), 0) * a.s * b.s)) AS w FROM e a JOIN e b ON a.query_id = b.query_id AND a.id < b.id GROUP BY 1),
r AS (SELECT query_id, list_avg(w[1:3]) AS h, list_avg(w[-3:]) AS l FROM p) SELECT query_id, round(CASE WHEN l > 0 THEN h / l WHEN h > 0 THEN 'inf'::DOUBLE END, 5) AS ratio FROM r"""
)
def apair_ratio(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    own = vector_hits(spark, sf_dir, 10).select("query_id", "id").join(v, "id").join(asked, "query_id")
    return policy.pair_ratio(own).select("query_id", F.round("ratio", 5).alias("ratio"))


@query(f"SELECT item_id, len(string_split({SQUEEZE.format('text')}, ' ')) >= 12 OR " + " OR ".join(f"contains(lower(text), '{c}')" for c in policy.RICH_CUES) + " AS rich FROM benchmark")
def query_router(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", policy.rich_route(F.col("text")).alias("rich"))


@query(
    """WITH v AS (SELECT user_id AS query_id, CASE event_type WHEN 'purchase' THEN 'SUPPORTED' WHEN 'error' THEN 'CONTRADICTED' ELSE 'OTHER' END AS vote FROM events),
n AS (SELECT query_id, count(*) FILTER (WHERE vote = 'SUPPORTED') AS s, count(*) FILTER (WHERE vote = 'CONTRADICTED') AS c FROM v GROUP BY 1)
SELECT query_id, CASE WHEN s > 0 AND c > 0 THEN 'MIXED' WHEN s > 0 THEN 'SUPPORTED' WHEN c > 0 THEN 'CONTRADICTED' ELSE 'INSUFFICIENT' END AS verdict FROM n"""
)
def verdict_aggregate(spark, sf_dir):
    vote = F.when(F.col("event_type") == "purchase", "SUPPORTED").when(F.col("event_type") == "error", "CONTRADICTED").otherwise("OTHER")
    return policy.verdict(read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), vote.alias("vote")))


# Graph

GRAPH_STOP = ", ".join(f"'{w}'" for w in graph.STOPWORDS)
GRAPH_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({GRAPH_STOP})))"
# Letters beyond ASCII stand as _ where words' edges are looked for, as SQL's regular expressions count ASCII letters alone.
NAMES = rf"""e0 AS (SELECT doc_id, {STRIP.format("coalesce(source, '')")} AS title, regexp_extract_all(regexp_replace(coalesce(text, ''), '[À-ɏ]', '_', 'g'), '\b[A-Z][A-Za-z0-9''&.-]+(?:\s+[A-Z][A-Za-z0-9''&.-]+){{0,3}}\b') AS runs FROM documents),
e1 AS (SELECT doc_id, list_filter([title] || runs, lambda x: length(x) >= 3) AS ns FROM e0), e2 AS (SELECT doc_id, unnest(range(len(ns))) AS i, unnest(ns) AS x FROM e1),
e3 AS (SELECT doc_id, i, array_to_string(list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda t: t NOT IN ({GRAPH_STOP})), ' ') AS entity FROM e2),
e4 AS (SELECT doc_id, entity, min(i) AS i FROM e3 WHERE entity <> '' GROUP BY 1, 2), m AS (SELECT doc_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM e4 QUALIFY place < 16)"""


def doc_mentions(spark, sf_dir):
    """The source stands for the title."""
    return graph.mentions(read(spark, sf_dir, "documents"))


def mentions_once(spark, sf_dir):
    """`doc_mentions` as a table in the shared folder, for plans that read it several times."""
    return written(doc_mentions(spark, sf_dir), "mentions")


@query(f"WITH {NAMES} SELECT doc_id, entity FROM m")
def entity_extract(spark, sf_dir):
    return doc_mentions(spark, sf_dir).select("doc_id", "entity")


@query(f"WITH {NAMES} SELECT entity, count(DISTINCT doc_id) AS freq FROM m GROUP BY 1")
def entity_frequency(spark, sf_dir):
    return graph.frequencies(doc_mentions(spark, sf_dir))


GROUPS = f"""{NAMES}, gk AS (SELECT doc_id, split_part(entity, ' ', 1) AS community, count(*) AS n, min(place) AS p FROM m GROUP BY 1, 2), gb AS (SELECT doc_id, community FROM gk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1),
gr AS (SELECT doc_id, coalesce(community, 'misc') AS community FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN gb USING (doc_id)),
cn AS (SELECT community, entity, count(DISTINCT doc_id) AS docs FROM m JOIN gr USING (doc_id) GROUP BY 1, 2), ce AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY docs DESC, entity) AS rank FROM cn QUALIFY rank <= 8),
cs AS (SELECT community, count(*) AS size FROM gr GROUP BY 1)"""


def doc_graph(spark, sf_dir, m: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the documents' graph, from mentions that are looked for once and written.

    It has no links between documents (plans.links has them), so each document has the same rank.
    """
    docs = read(spark, sf_dir, "documents")
    m = mentions_once(spark, sf_dir) if m is None else m
    groups = written(graph.document_groups(docs, m), "groups")
    titles = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("title"))
    return {
        "documents": docs.select("doc_id", "source", "text"),
        "mentions": m,
        "entities": graph.frequencies(m).withColumn("group_key", graph.group_key(F.col("entity"))),
        "groups": m.select(graph.group_key(F.col("entity")).alias("group_key")).distinct(),
        "community_docs": groups,
        "community_entities": graph.community_entities(m, groups, "community", 8),
        "communities": graph.community_table(groups, m, titles),
    }


@query(
    f"""WITH {GROUPS}, e AS (SELECT community, string_agg(entity, ', ' ORDER BY rank) AS e FROM ce WHERE rank <= 4 GROUP BY 1), tt AS (SELECT community, source, row_number() OVER (PARTITION BY community ORDER BY doc_id) AS n FROM gr JOIN documents USING (doc_id) QUALIFY n <= 4),
t AS (SELECT community, string_agg(coalesce(source, ''), ', ' ORDER BY n) AS t FROM tt GROUP BY 1) SELECT cs.community, size, 'Community ' || cs.community || ' centers on ' || coalesce(e, 'linked topics') || '. Representative pages: ' || t || '.' AS summary FROM cs LEFT JOIN e USING (community) JOIN t USING (community)"""
)
def communities(spark, sf_dir):
    return doc_graph(spark, sf_dir)["communities"]


@query(
    f"""WITH {GROUPS} SELECT 'documents' AS "table", (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 'mentions', (SELECT count(*) FROM m) UNION ALL SELECT 'entities', (SELECT count(DISTINCT entity) FROM m) UNION ALL SELECT 'groups', (SELECT count(DISTINCT split_part(entity, ' ', 1)) FROM m)
UNION ALL SELECT 'community_docs', (SELECT count(*) FROM gr) UNION ALL SELECT 'community_entities', (SELECT count(*) FROM ce) UNION ALL SELECT 'communities', (SELECT count(*) FROM cs)"""
)
def graph_statistics(spark, sf_dir):
    return graph.statistics(doc_graph(spark, sf_dir))


MATCHED = f"""{GROUPS}, q AS (SELECT item_id AS query_id, unnest({GRAPH_TERMS}) AS t FROM benchmark), fr AS (SELECT entity, count(DISTINCT doc_id) AS freq FROM m GROUP BY 1),
w AS (SELECT entity, freq, unnest(list_distinct(string_split(entity, ' '))) AS t FROM fr), n AS (SELECT query_id, entity, freq, count(*) AS overlap FROM q JOIN w USING (t) GROUP BY ALL),
matched AS (SELECT query_id, entity, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, freq DESC, entity DESC) AS rank FROM n QUALIFY rank <= 6)"""


def asked_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", "text", graph.query_terms(F.col("text")).alias("terms"))


def matched(spark, sf_dir, m: DataFrame | None = None):
    """A row for each query and entity, six a query; written where mentions are, as others read both."""
    found = graph.match_entities(asked_terms(spark, sf_dir), graph.frequencies(doc_mentions(spark, sf_dir) if m is None else m))
    return found if m is None else written(found, "matched")


@query(f"WITH {MATCHED} SELECT query_id, entity, overlap, rank FROM matched")
def entity_match(spark, sf_dir):
    return matched(spark, sf_dir)


def same_rank(spark, sf_dir) -> DataFrame:
    """(node, rank) of the documents: without links between them, one over their number."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node")).distinct()
    return docs.crossJoin(F.broadcast(docs.agg((F.lit(1.0) / F.count("*")).alias("rank"))))  # the rank: one row


SEEDED = "rk AS (SELECT 1.0 / count(DISTINCT doc_id) AS r FROM documents), sd AS (SELECT query_id, doc_id AS id, sum(1 + r) AS score FROM matched JOIN m USING (entity), rk GROUP BY ALL)"
# Parts of a query that ask for the whole rather than for a place in it, and what the side that is asked for gains.
GLOBAL_CUES, GLOBAL_BOOST = ["overall", "why", "how did", "relationship", "connection", "between"], 1.6
GLOBAL = "(" + " OR ".join(f"contains(lower(text), '{x}')" for x in GLOBAL_CUES) + ")"


def graph_contexts(spark, sf_dir, light: bool) -> DataFrame:
    """(query_id, kind, id, score): the two best documents by their entities, and the two best communities."""
    cue = F.lit(False)
    for x in GLOBAL_CUES:
        cue = cue | F.contains(F.lower("text"), F.lit(x))
    m = mentions_once(spark, sf_dir)
    found = matched(spark, sf_dir, m).join(questions(spark, sf_dir).select("query_id", (cue & F.lit(light)).alias("whole")), "query_id")
    g = doc_graph(spark, sf_dir, m)
    wide = F.when(F.col("whole"), GLOBAL_BOOST).otherwise(1.0)
    local = F.when(F.lit(light) & ~F.col("whole"), GLOBAL_BOOST).otherwise(1.0)
    docs = graph.seeded_documents(found, g["mentions"], same_rank(spark, sf_dir)).join(found.select("query_id", "whole").distinct(), "query_id")
    docs = retrieval.top_k(docs.select("query_id", F.col("doc_id").alias("id"), (F.col("score") * local).alias("score")), 2)
    groups = graph.community_scores(found, g["community_entities"], g["communities"], wide, 2)
    return docs.select("query_id", F.lit("document").alias("kind"), F.col("id").cast("string").alias("id"), "score").unionByName(groups.select("query_id", F.lit("community").alias("kind"), F.col("community").alias("id"), "score"))


def graph_sql(local: str, wide: str) -> str:
    return f"""WITH {MATCHED}, {SEEDED}, bq AS (SELECT item_id AS query_id, {GLOBAL} AS whole FROM benchmark), sb AS (SELECT query_id, id, score * ({local}) AS score FROM sd JOIN bq USING (query_id)), {top_sql("sb", 2, "t")},
co AS (SELECT query_id, community AS id, count(DISTINCT matched.entity) AS o FROM matched JOIN ce USING (entity) GROUP BY 1, 2), cc AS (SELECT query_id, id, ({wide}) * (o + 0.1 * size) AS score FROM co JOIN cs ON cs.community = co.id JOIN bq USING (query_id)),
ct AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id DESC) <= 2)
SELECT query_id, 'document' AS kind, CAST(id AS VARCHAR) AS id, round(score, 6) AS score FROM t UNION ALL SELECT query_id, 'community', id, round(score, 6) FROM ct"""


@query(graph_sql("1.0", "1.0"))
def graph_route(spark, sf_dir):
    """Documents that mention matched entities, and communities that name them."""
    return graph_contexts(spark, sf_dir, False).withColumn("score", F.round("score", 6))


@query(graph_sql("CASE WHEN whole THEN 1.0 ELSE 1.6 END", "CASE WHEN whole THEN 1.6 ELSE 1.0 END"))
def light_route(spark, sf_dir):
    """The same, with the side that the query asks for boosted."""
    return graph_contexts(spark, sf_dir, True).withColumn("score", F.round("score", 6))


ROUTED = f"""{MATCHED}, rk AS (SELECT 1.0 / count(DISTINCT doc_id) AS r FROM documents), mg AS (SELECT query_id, t AS g FROM q UNION SELECT query_id, split_part(entity, ' ', 1) FROM matched), dm AS (SELECT DISTINCT doc_id, entity FROM m),
rw AS (SELECT query_id, doc_id AS id, 0.75 + r AS w FROM mg JOIN dm ON split_part(entity, ' ', 1) = g, rk UNION ALL SELECT query_id, doc_id, 1.5 FROM matched JOIN dm USING (entity)), rs AS (SELECT query_id, id, sum(w) AS score FROM rw GROUP BY ALL), {top_sql("rs", 2, "rt")}"""


@query(f"WITH {ROUTED} SELECT query_id, id, rank, round(score, 6) AS score FROM rt")
def linear_route(spark, sf_dir):
    """Documents by the groups and entities that the query matches."""
    return linear_hits(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def linear_hits(spark, sf_dir):
    rank = F.broadcast(read(spark, sf_dir, "documents").agg((F.lit(1.0) / F.countDistinct("doc_id")).alias("rank")))  # one row
    m = mentions_once(spark, sf_dir)
    return retrieval.top_k(graph.routed_documents(matched(spark, sf_dir, m), asked_terms(spark, sf_dir), m.select("doc_id", "entity").crossJoin(rank)).withColumnRenamed("doc_id", "id"), 2)


@query(
    f"""WITH {ROUTED}, {bm25_sql("documents", "doc_id", "text", "bm")}, {top_sql("bm", 5, "bt")},
z AS (SELECT query_id, id, 0 AS p, rank FROM rt UNION ALL SELECT query_id, id, 1, rank FROM bt), o AS (SELECT query_id, id, min((p, rank)) AS pl FROM z GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pl, id) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pl, id) <= 5"""
)
def graph_first(spark, sf_dir):
    """The graph's documents, then the lexical list's."""
    return fusion.anchors_first(linear_hits(spark, sf_dir), doc_hits(spark, sf_dir, 5), 5)


@query()
def walk_route(spark, sf_dir):
    """The two documents that a walk from the matched entities, and from what mentions them, visits most, and a community."""
    m = mentions_once(spark, sf_dir)
    found = matched(spark, sf_dir, m)
    g = doc_graph(spark, sf_dir, m)
    none = F.lit(None)
    own = found.select("query_id", "entity", none.cast("string").alias("doc_id"), F.lit(1.0).alias("weight"))
    near = found.join(g["mentions"], "entity").select("query_id", none.cast("string").alias("entity"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0.25).alias("weight"))
    docs = graph.best_walked(own.unionByName(near), g["mentions"], 2)
    groups = graph.community_scores(found, g["community_entities"], g["communities"], F.lit(1.0), 1)
    return docs.select("query_id", F.lit("document").alias("kind"), "id", "score").unionByName(groups.select("query_id", F.lit("community").alias("kind"), F.col("community").alias("id"), "score"))


def nation_edges(spark, sf_dir):
    """How many orders customers of one nation have placed with suppliers of another."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def rank_sql(base: str) -> str:
    """Fifty rounds, written out as a recursive query over the matrix."""
    return f"""WITH RECURSIVE e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), b AS (SELECT n_nationkey AS node, {base} AS b FROM nation),
m AS (SELECT list({{'s': x.node, 'd': y.node, 'p': coalesce(p, y.b)}}) AS m FROM b x CROSS JOIN b y LEFT JOIN p ON src = x.node AND dst = y.node WHERE p IS NOT NULL OR x.node NOT IN (SELECT src FROM p)),
v(i, r) AS (SELECT 0, map_from_entries(list((node, b))) FROM b
UNION ALL SELECT i + 1, (SELECT map_from_entries(list((node, 0.85 * coalesce(list_sum(list_transform(list_filter(m.m, lambda z: z.d = node), lambda z: z.p * v.r[z.s])), 0) + 0.15 * b))) FROM b) FROM v, m WHERE i < 50)
SELECT unnest(map_keys(r)) AS node, round(unnest(map_values(r)), 5) AS rank FROM v WHERE i = 50"""


@query(rank_sql("1 / 25"))
def pagerank(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.pagerank(nodes, nation_edges(spark, sf_dir)).select("node", F.round("rank", 5).alias("rank"))


@query(rank_sql("CASE WHEN n_nationkey < 2 THEN 0.5 ELSE 0 END::DOUBLE"))
def ppr_walk(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    seeds = nodes.where("node < 2").select("node", F.lit(1.0).alias("weight"))
    return graph.pagerank(nodes, nation_edges(spark, sf_dir), seeds).select("node", F.round("rank", 5).alias("rank"))


# Variants


@query()
def chunk_structure_aware(spark, sf_dir):
    return variants.structure_chunks(read(spark, sf_dir, "documents"))


FIRST = f"({SENTENCES.format('chunk')})[1]"


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index // 4 AS BIGINT) AS node, count(*) AS n_children, string_agg({FIRST}, ' ' ORDER BY chunk_index) AS summary FROM chunks GROUP BY 1, 2")
def raptor_tree(spark, sf_dir):
    return variants.summary_tree(ingest.chunks(read(spark, sf_dir, "documents"))).withColumn("n_children", F.col("n_children").cast("bigint"))


@query(f"WITH {CHUNKS}, p AS (SELECT doc_id, CAST(chunk_index // 4 + 1 AS BIGINT) AS page_number, flatten(list({SENTENCES.format('chunk')} ORDER BY chunk_index)) AS ss FROM chunks GROUP BY 1, 2) SELECT doc_id, page_number, substr(array_to_string(ss[1:4], ' '), 1, 800) AS page FROM p WHERE len(ss) > 0")
def page_tree(spark, sf_dir):
    return variants.pages(ingest.chunks(read(spark, sf_dir, "documents")))


LABELLED = [(variants.DATED, r"(^|[^\p{L}\p{N}_])[0-9]{4}($|[^\p{L}\p{N}_])"), *((n, "|".join(w)) for n, w in variants.LABELS)]


@query(
    "WITH s AS (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS t FROM documents) SELECT doc_id, coalesce(nullif(array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in LABELLED)
    + f"], lambda x: x IS NOT NULL), ' > '), ''), '{variants.GENERAL}') AS labels FROM s"
)
def taxonomy_label(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", variants.taxonomy(F.col("source"), F.col("text")).alias("labels"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda s: string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ')), lambda w: len(w) >= 5)[1:8] AS ws FROM documents),
e AS (SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS n, unnest(ws) AS w FROM s) SELECT doc_id, n, array_to_string(w[1:2], ' ') AS subject, w[3] AS relation, array_to_string(w[4:7], ' ') AS object FROM e"""
)
def triples(spark, sf_dir):
    return variants.triples(read(spark, sf_dir, "documents"))


from sparkwell.plans import answering, records  # noqa: E402, F401  their queries register here
from sparkwell.plans import chunks, evaluation, hybrid, rounds, tables  # noqa: E402, F401
from sparkwell.plans import critique, index, links, sessions  # noqa: E402, F401
