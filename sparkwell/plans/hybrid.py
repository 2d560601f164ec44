"""Dense and lexical lists over the same corpus: routes, anchors, sub-queries, gates and evidence.

Dense lists are by hashed embeddings (operators.embedding), which stand in for a model's vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T
from sparkwell.operators import embedding, fusion, graph, policy, retrieval
from sparkwell.storage import written

# A word's edges, with letters and digits of any script.
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Parts of a query that ask for an exact route, and for lexical anchors; the score that a dense list must reach.
EXACT_CUES = ["when", "where", "year", "date", "born", "died", '"']
ANCHOR_CUES = ["according to", "called", "named", "titled", "class a", "series"]
LEAST_SCORE = 1.35


def has(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(F.lower(text), F.lit(cue))
    return out


def exact_route(query: Column) -> Column:
    """True for queries that go to the lexical list alone: a cue, or a year."""
    return has(query, EXACT_CUES) | query.rlike(EDGE + r"\d{4}" + END)


def anchor_route(query: Column) -> Column:
    """True for queries with quotes, two capitalised words of three characters or more, numbers, or a cue.

    A word may have points and hyphens, but ends at a letter's or digit's edge: the full stop behind a short word doesn't lengthen it.
    """
    rare = F.size(F.regexp_extract_all(query, F.lit(EDGE + r"[A-Z][A-Za-z0-9&.-]{2,}" + graph.EDGE), F.lit(0))) >= 2
    return query.rlike("[\"']") | rare | query.rlike(r"\$\d|" + EDGE + r"\d+(\.\d+)?" + "(%|" + END + ")") | has(query, ANCHOR_CUES)


def longest(found: Column) -> Column:
    """The first of the longest strings of an array."""
    return F.array_max(F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]


def anchor(query: Column) -> Column:
    """A query's entity: up to two acronyms, else the longest run of capitalised words, else the longest quotation, else nothing."""
    acronyms = F.regexp_extract_all(query, F.lit(EDGE + r"[A-Z]{2,}(?:/[A-Z]+)?" + END), F.lit(0))
    names = F.regexp_extract_all(query, F.lit(EDGE + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}" + END), F.lit(0))
    quotes = F.transform(F.regexp_extract_all(query, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return F.when(F.size(acronyms) > 0, F.array_join(F.slice(acronyms, 1, 2), " ")).otherwise(F.coalesce(longest(names), longest(quotes), F.lit("")))


def parts_of(query: Column) -> Column:
    """The query and its parts: about both ... and ..., else about before or after, else about or; parts of three words or more, three strings in all."""
    low = F.lower(query)
    split = lambda words: F.transform(F.filter(F.split(query, EDGE + f"(?:{words})" + END), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= 3), lambda x: F.regexp_replace(x, r"^[ ?]+|[ ?]+$", ""))
    none = F.array().cast("array<string>")
    more = F.when(low.contains(" both ") & low.contains(" and "), split("and")).when(low.contains(" before ") | low.contains(" after "), split("before|after")).when(low.contains(" or "), split("or")).otherwise(none)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(query), more), lambda x: x != "")), 1, 3)


# Words that a question's form adds to it.
EXPANSIONS = [
    ("^who", ["person", "identity"]),
    (r"^when|(^|[^\p{L}\p{N}_])[0-9]{4}($|[^\p{L}\p{N}_])", ["date", "year", "time"]),
    ("^where", ["place", "location"]),
    ("both|and", ["comparison", "bridge"]),
    ("^is |^was ", ["yes no"]),
    ("capital|city|river|country", ["geography", "location"]),
    ("born|died|married|played|wrote", ["biography", "person"]),
]


def expansion(query: Column) -> Column:
    """The words that rules add to a query, joined by spaces."""
    return F.array_join(F.flatten(F.array(*(F.when(F.lower(query).rlike(p), F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>")) for p, w in EXPANSIONS))), " ")


def answer_bonus(question: Column, haystack: Column) -> Column:
    """What a context gains by having what the question's first word asks for; haystack is in lower case."""
    low = F.lower(question)
    year = r"(^|[^\p{L}\p{N}_])[0-9]{4}($|[^\p{L}\p{N}_])"
    fits = lambda p, bonus: F.when(haystack.rlike(p), bonus).otherwise(0.0)
    who = fits(EDGE + "[a-z]+ [a-z]+" + END, 0.25)
    # What marks a place, and an answer of yes or no.
    place, closed = fits(" in | at | city| country| state| province", 0.25), fits("yes|no|not|did|was", 0.15)
    return F.when(low.rlike("^(who|whose)"), who).when(low.rlike("^when") | low.rlike(year), fits(year, 0.25)).when(low.rlike("^where"), place).when(low.rlike("^(is|was|were|did|does) "), closed).otherwise(0.0)


def clauses(text: Column) -> Column:
    """Clauses of a text: cut behind . ; ! ? and at line ends, without spaces and semicolons around them."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;!?])\s+|\n+"), lambda x: F.regexp_replace(x, "^[ ;]+|[ ;]+$", "")), lambda x: x != "")


def clause_gate(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., aggregate, coverage, kept) of clauses' votes (by..., verdict): an answer stays if 0.6 of its clauses are supported and none contradicted.

    SUPPORTED counts as such, CONTRADICTED against, all else as insufficient.
    """
    n = votes.groupBy(*by).agg(F.count_if(F.col("verdict") == "SUPPORTED").alias("s"), F.count_if(F.col("verdict") == "CONTRADICTED").alias("x"), F.count("*").alias("n"))
    none = F.col("s") == 0
    name = F.when(none & (F.col("x") > 0), "CONTRADICTED").when(none & (F.col("n") > F.col("x")), "INSUFFICIENT").when(F.col("x") > 0, "MIXED").otherwise("SUPPORTED")
    out = n.select(*by, name.alias("aggregate"), (F.col("s") / F.greatest(F.col("n"), F.lit(1))).alias("coverage"))
    return out.withColumn("kept", (F.col("coverage") >= 0.6) & (F.col("aggregate") == "SUPPORTED"))


def dense_hits(queries: DataFrame, docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine of hashed embeddings."""
    vectors = docs.select(F.col(id_col).alias("id"), embedding.hashed_vector(F.col(text)).alias("embedding"))
    return retrieval.cosine_top_k(queries.select("query_id", embedding.hashed_vector(F.col("text")).alias("embedding")), vectors, k)


def lists(spark, sf_dir, k: int, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    docs = c.read(spark, sf_dir, "documents")
    q = c.questions(spark, sf_dir) if queries is None else queries
    return dense_hits(q, docs, "doc_id", "text", k), retrieval.bm25_top_k(q, docs, "doc_id", "text", k)


# SQL

EMBED = "list_transform(range(64), lambda i: CAST(len(list_filter({}, lambda x: x = i)) AS DOUBLE))"
BUCKETS = f"list_transform({c.TOKENS}, lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % 64)"
ASKED = "(SELECT item_id AS query_id, text FROM benchmark)"


def cosine_sql(k: int, name: str = "d", queries: str = ASKED) -> str:
    return f"""{name}b AS (SELECT doc_id AS id, {BUCKETS.format("text")} AS b FROM documents), {name}v AS (SELECT id, {EMBED.format("b")} AS v FROM {name}b),
{name}p AS (SELECT query_id, {BUCKETS.format("text")} AS b FROM {queries}), {name}q AS (SELECT query_id, {EMBED.format("b")} AS v FROM {name}p),
{name}s AS (SELECT query_id, id, 1 + CASE WHEN list_sum(q.v) = 0 OR list_sum(x.v) = 0 THEN 0 ELSE list_cosine_similarity(q.v, x.v) END AS score FROM {name}q q, {name}v x), {c.top_sql(name + "s", k, name)}"""


def both_sql(k: int) -> str:
    return f"WITH {c.DOC_BM25}, {c.top_sql('m', k, 'l')}, {cosine_sql(k)}"


RRF = "SELECT query_id, id, rank, round(rrf, 9) AS rrf FROM g"


def shown(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"))


@c.query(f"{both_sql(5)} SELECT query_id, id, rank, round(score, 6) AS score FROM d")
def dense_topk(spark, sf_dir):
    return lists(spark, sf_dir, 5)[0].select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@c.query(f"{both_sql(10)}, {c.fuse_sql(5)} {RRF}")
def hybrid_fuse(spark, sf_dir):
    a, b = lists(spark, sf_dir, 10)
    return shown(fusion.rrf([(a, 1.0), (b, 1.0)], 5))


HEAVY = r"""regexp_matches(text, '[0-9"'']') OR regexp_matches(text, '\b[A-Z]{2,}\b')"""


def fused_from(u: str, k: int) -> str:
    return f"""u AS ({u}), f AS (SELECT query_id, id, sum(w) AS rrf, min((list, rank, score)) AS first FROM u GROUP BY ALL),
g AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, round(first[3], 9) DESC, first[1], first[2], id) AS rank FROM f QUALIFY rank <= {k})"""


@c.query(
    f"""{both_sql(10)}, qw AS (SELECT item_id AS query_id, CASE WHEN {HEAVY} THEN 1.0 WHEN len(string_split({c.SQUEEZE.format("text")}, ' ')) <= 6 THEN 2.0 ELSE 1.0 END AS wd, CASE WHEN {HEAVY} THEN 3.0 ELSE 1.0 END AS wl FROM benchmark),
{fused_from("SELECT query_id, id, 0 AS list, rank, score, wd / (60 + rank) AS w FROM d JOIN qw USING (query_id) UNION ALL SELECT query_id, id, 1, rank, score, wl / (60 + rank) FROM l JOIN qw USING (query_id)", 5)} {RRF}"""
)
def hybrid_weighted(spark, sf_dir):
    """Each query weighs its lists by its own words."""
    a, b = lists(spark, sf_dir, 10)
    dense, lexical = fusion.list_weights(F.col("text"))
    w = c.questions(spark, sf_dir).select("query_id", dense.alias("wd"), lexical.alias("wl"))
    return shown(fusion.rrf([(a.join(w, "query_id"), "wd"), (b.join(w, "query_id"), "wl")], 5))


# The text with letters and digits beyond ASCII as _, which the edges of words of SQL's regular expressions count in.
WORDED = r"array_to_string(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 127 AND regexp_matches(x, '[\p{L}\p{N}]') THEN '_' ELSE x END), '')"
LONGEST = "list_reduce({0}, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)"
ANCHORS = (
    "an0 AS (SELECT item_id AS query_id, " + WORDED + r""" AS wt, regexp_extract_all(wt, '\b[A-Z]{2,}(?:/[A-Z]+)?\b') AS a, regexp_extract_all(wt, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b') AS n, regexp_extract_all(text, '"[^"]+"|''[^'']+''') AS q FROM benchmark),
anchors AS (SELECT query_id, CASE WHEN len(a) > 0 THEN array_to_string(a[1:2], ' ') WHEN len(n) > 0 THEN """
    + LONGEST.format("n")
    + " WHEN len(q) > 0 THEN trim("
    + LONGEST.format("q")
    + """, '"''') ELSE '' END AS text FROM an0)"""
)


def anchors(spark, sf_dir) -> DataFrame:
    return c.questions(spark, sf_dir).select("query_id", anchor(F.col("text")).alias("text"))


@c.query(f"WITH {ANCHORS} SELECT * FROM anchors")
def entity_anchor(spark, sf_dir):
    return anchors(spark, sf_dir)


@c.query(
    f"""{both_sql(10)}, {ANCHORS}, {c.bm25_sql("documents", "doc_id", "text", "a", "(SELECT * FROM anchors WHERE text <> '')")}, {c.top_sql("a", 10, "e")},
{fused_from("SELECT query_id, id, 0 AS list, rank, score, 1.0 / (60 + rank) AS w FROM d UNION ALL SELECT query_id, id, 1, rank, score, 1.0 / (60 + rank) FROM l UNION ALL SELECT query_id, id, 2, rank, score, 1.0 / (60 + rank) FROM e", 5)} {RRF}"""
)
def hybrid_anchor(spark, sf_dir):
    """Three lists: dense, lexical, and lexical by the query's entity."""
    a, b = lists(spark, sf_dir, 10)
    e = retrieval.bm25_top_k(anchors(spark, sf_dir).where("text <> ''"), c.read(spark, sf_dir, "documents"), "doc_id", "text", 10)
    return shown(fusion.rrf([(a, 1.0), (b, 1.0), (e, 1.0)], 5))


@c.query(
    f"""WITH {ANCHORS}, {c.bm25_sql("documents", "doc_id", "text", "a", "(SELECT * FROM anchors WHERE text <> '')")}, {c.top_sql("a", 5, "e")}, {c.DOC_BM25}, {c.top_sql("m", 5, "l")}
SELECT query_id, id, rank, 0 AS list FROM e UNION ALL SELECT query_id, id, rank, 1 FROM l WHERE query_id NOT IN (SELECT query_id FROM e)"""
)
def fallback_lists(spark, sf_dir):
    """By the entity where that finds anything, else by the whole query."""
    docs = c.read(spark, sf_dir, "documents")
    e = retrieval.bm25_top_k(anchors(spark, sf_dir).where("text <> ''"), docs, "doc_id", "text", 5)
    return fusion.first_filled_list([e, retrieval.bm25_top_k(c.questions(spark, sf_dir), docs, "doc_id", "text", 5)]).select("query_id", "id", "rank", "list")


# Two texts of the corpus make a question of two parts.
TWO = "SELECT a.item_id AS query_id, a.text || ' or ' || b.text || '?' AS text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"
SUBS = f"""tw AS ({TWO}), sp AS (SELECT query_id, text, CASE WHEN contains(lower(text), ' both ') AND contains(lower(text), ' and ') THEN 'and' WHEN contains(lower(text), ' before ') OR contains(lower(text), ' after ') THEN 'before|after' ELSE 'or' END AS w FROM tw),
se AS (SELECT query_id, [text] || list_transform(list_filter(string_split(regexp_replace(text, '\\b(' || w || ')\\b', chr(1), 'g'), chr(1)), lambda x: len(list_filter(string_split({c.SQUEEZE.format("x")}, ' '), lambda y: y <> '')) >= 3), lambda x: trim(x, ' ?')) AS ps FROM sp),
sd AS (SELECT query_id, list_filter(ps, lambda x, i: x <> '' AND list_position(ps, x) = i)[1:3] AS ps FROM se), subs AS (SELECT query_id AS whole, unnest(range(len(ps))) AS n, unnest(ps) AS text FROM sd)"""


def two_part_questions(spark, sf_dir) -> DataFrame:
    q = c.questions(spark, sf_dir)
    other = q.select((F.col("query_id") - 1).alias("query_id"), F.col("text").alias("other"))
    return q.join(other, "query_id").select("query_id", F.concat("text", F.lit(" or "), "other", F.lit("?")).alias("text"))


@c.query(f"WITH {SUBS} SELECT whole AS query_id, CAST(n AS INTEGER) AS n, text FROM subs")
def sub_queries(spark, sf_dir):
    return two_part_questions(spark, sf_dir).select("query_id", F.posexplode(parts_of(F.col("text"))).alias("n", "text"))


@c.query(
    f"""WITH {SUBS}, sq AS (SELECT whole || '#' || n AS query_id, text FROM subs), {c.bm25_sql("documents", "doc_id", "text", "m", "sq")}, {c.top_sql("m", 10, "l")}, {cosine_sql(10, "d", "sq")},
{fused_from("SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS query_id, id, 2 * CAST(split_part(query_id, '#', 2) AS INTEGER) AS list, rank, score, 1.0 / (60 + rank) AS w FROM d UNION ALL SELECT CAST(split_part(query_id, '#', 1) AS BIGINT), id, 2 * CAST(split_part(query_id, '#', 2) AS INTEGER) + 1, rank, score, 1.0 / (60 + rank) FROM l", 5)} {RRF}"""
)
def hybrid_subqueries(spark, sf_dir):
    """The lists of a question and of its parts, fused."""
    subs = sub_queries(spark, sf_dir).select(F.concat(F.col("query_id").cast("string"), F.lit("#"), F.col("n").cast("string")).alias("query_id"), "text")
    found = [written(x, "list") for x in lists(spark, sf_dir, 10, subs)]
    whole = [x.select(F.split("query_id", "#")[0].cast("long").alias("query_id"), F.split("query_id", "#")[1].cast("int").alias("n"), "id", "rank", "score") for x in found]
    return shown(fusion.rrf([(whole[i].where(F.col("n") == n), 1.0) for n in range(3) for i in range(2)], 5))


ROUTED = f"rt AS (SELECT item_id, text, {WORDED} AS wt FROM benchmark)"
ANCHORED = r"(regexp_matches(text, '[\"'']') OR len(regexp_extract_all(wt, '\b[A-Z][A-Za-z0-9&.-]{2,}\b')) >= 2 OR regexp_matches(wt, '\$[0-9]|\b[0-9]+(\.[0-9]+)?(%|\b)') OR " + " OR ".join(f"contains(lower(text), '{x}')" for x in ANCHOR_CUES) + ")"
EXACT = "(" + " OR ".join(f"contains(lower(text), '{x}')" for x in EXACT_CUES) + r" OR regexp_matches(wt, '\b[0-9]{4}\b'))"


@c.query(f"WITH {ROUTED} SELECT item_id, {ANCHORED} AS anchored, {EXACT} AS exact FROM rt")
def query_routes(spark, sf_dir):
    return c.read(spark, sf_dir, "benchmark").select("item_id", anchor_route(F.col("text")).alias("anchored"), exact_route(F.col("text")).alias("exact"))


@c.query(
    f"""{both_sql(10)}, {c.fuse_sql(5)}, {ROUTED}, ex AS (SELECT item_id AS query_id FROM rt WHERE {EXACT})
SELECT query_id, id, rank FROM l WHERE rank <= 5 AND query_id IN (SELECT query_id FROM ex) UNION ALL SELECT query_id, id, rank FROM g WHERE query_id NOT IN (SELECT query_id FROM ex)"""
)
def exact_bypass(spark, sf_dir):
    """Exact questions go to the lexical list alone, others to both."""
    a, b = lists(spark, sf_dir, 10)
    exact = c.questions(spark, sf_dir).where(exact_route(F.col("text"))).select("query_id")
    fused = fusion.rrf([(a, 1.0), (b, 1.0)], 5).join(exact, "query_id", "left_anti").select("query_id", "id", "rank")
    return b.where("rank <= 5").join(exact, "query_id", "left_semi").select("query_id", "id", "rank").unionByName(fused)


@c.query(
    "SELECT item_id, concat_ws(' ', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{' '.join(w)}' END" for p, w in EXPANSIONS) + ") AS words FROM benchmark"
)
def query_expansion(spark, sf_dir):
    return c.read(spark, sf_dir, "benchmark").select("item_id", expansion(F.col("text")).alias("words"))


@c.query(
    f"""{both_sql(100)}, nd AS (SELECT query_id, coalesce(stddev_pop(score) / abs(avg(score)), 0) AS v FROM d WHERE score > 0 GROUP BY 1), nl AS (SELECT query_id, coalesce(stddev_pop(score) / abs(avg(score)), 0) AS v FROM l WHERE score > 0 GROUP BY 1),
r AS (SELECT item_id AS query_id, coalesce(nd.v, 0) AS dense, coalesce(nl.v, 0) AS lexical FROM benchmark LEFT JOIN nd ON nd.query_id = item_id LEFT JOIN nl ON nl.query_id = item_id)
SELECT query_id, round(dense, 6) AS dense, round(lexical, 6) AS lexical, CASE WHEN round(dense, 9) >= 0.10 AND round(lexical, 9) >= 0.10 THEN 'fuse' WHEN round(dense, 9) >= 0.10 THEN 'vector' WHEN round(lexical, 9) >= 0.10 THEN 'text' ELSE 'retry' END AS route FROM r"""
)
def nqc_plan(spark, sf_dir):
    """Four routes by the dispersion of both lists."""
    a, b = lists(spark, sf_dir, 100)
    rows = c.questions(spark, sf_dir).select("query_id")
    for name, hits in (("dense", a), ("lexical", b)):
        rows = rows.join(policy.dispersion(hits, 100).select("query_id", F.col("nqc").alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return rows.select("query_id", F.round("dense", 6).alias("dense"), F.round("lexical", 6).alias("lexical"), policy.list_route(F.round("dense", 9), F.round("lexical", 9)).alias("route"))


@c.query(
    f"""{both_sql(10)}, {c.fuse_sql(5)}, t AS (SELECT item_id AS query_id, coalesce((SELECT max(score) FROM d WHERE d.query_id = item_id), 0) AS top FROM benchmark)
SELECT t.query_id, round(top, 4) AS top_score, round(top, 9) < {LEAST_SCORE} AS low_confidence, CASE WHEN round(top, 9) < {LEAST_SCORE} THEN '' ELSE coalesce((SELECT string_agg(id, ' ' ORDER BY rank) FROM g WHERE g.query_id = t.query_id), '') END AS ids FROM t"""
)
def max_score_gate(spark, sf_dir):
    """No hits, and a mark, where the best dense score is too low."""
    a, b = lists(spark, sf_dir, 10)
    top = a.groupBy("query_id").agg(F.max("score").alias("top"))
    fused = fusion.rrf([(a, 1.0), (b, 1.0)], 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("f"))
    rows = c.questions(spark, sf_dir).select("query_id").join(top, "query_id", "left").join(fused, "query_id", "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    low = F.round("top", 9) < LEAST_SCORE
    return rows.select("query_id", F.round("top", 4).alias("top_score"), low.alias("low_confidence"), F.when(low, "").otherwise(F.coalesce(F.array_join(F.transform("f", lambda x: x["id"].cast("string")), " "), F.lit(""))).alias("ids"))


SHARED = f"""{c.CONTEXTS}, y AS (SELECT query_id, id, rank, score, text, split_part(text, chr(10), 1) AS title, len(list_filter({c.TERMS.format("query")}, lambda t: contains(lower(text), t))) AS overlap, length(text) AS size FROM x)"""


def overlapping(spark, sf_dir) -> DataFrame:
    shared = F.size(F.filter(T.query_terms(F.col("query")), lambda t: F.lower(F.col("text")).contains(t)))
    return c.contexts(spark, sf_dir).select("query_id", "id", "rank", "score", F.substring(F.md5(F.split("text", "\n")[0]), 1, 1).alias("title"), shared.alias("overlap"), F.length("text").alias("size"))


@c.query(
    f"""{SHARED}, w AS (SELECT *, substr(md5(title), 1, 1) AS grp FROM y), z AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, grp ORDER BY overlap DESC, round(score, 9) DESC, size, id) AS t FROM w)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, round(score, 9) DESC, size, id) AS place FROM z WHERE n <= 5 OR t <= 2 QUALIFY place <= 5"""
)
def title_cap(spark, sf_dir):
    """A hash digit of the first line groups contexts as a title would."""
    return fusion.capped(overlapping(spark, sf_dir), 5).select("query_id", "id", "place")


@c.query(
    f"""WITH {c.CHUNK_BM25}, {c.top_sql("m", 10, "t")}
SELECT query_id, id.doc_id AS doc_id, id.chunk_index AS chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY id.doc_id, id.chunk_index, round(score, 9) DESC) AS place FROM t"""
)
def reading_order(spark, sf_dir):
    """Hits in the order of their documents."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "chunk_index", F.round("score", 9).desc()))
    return c.chunk_hits(spark, sf_dir, 10).select("query_id", "doc_id", "chunk_index", place.alias("place"))


@c.query(
    f"""WITH {c.CHUNK_BM25}, {c.top_sql("m", 10, "t")}, x AS (SELECT t.query_id, t.id.doc_id AS doc_id, t.id.chunk_index AS chunk_index, t.score, len(list_filter({c.TERMS.format("b.text")}, lambda w: contains(lower(k.chunk), w))) AS overlap
FROM t JOIN benchmark b ON b.item_id = t.query_id JOIN chunks k ON k.doc_id = t.id.doc_id AND k.chunk_index = t.id.chunk_index)
SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_index // 4 + 1, round(score, 9) DESC, doc_id, chunk_index) AS place FROM x QUALIFY place <= 5"""
)
def page_ranking(spark, sf_dir):
    """By shared terms, then early pages, then score."""
    from sparkwell.operators import ingest

    q = c.questions(spark, sf_dir).select("query_id", T.query_terms(F.col("text")).alias("terms"))
    rows = c.chunk_hits(spark, sf_dir, 10).join(ingest.chunks(c.read(spark, sf_dir, "documents")), ["doc_id", "chunk_index"]).join(q, "query_id")
    shared = F.size(F.filter("terms", lambda t: F.lower(F.col("chunk")).contains(t)))
    order = Window.partitionBy("query_id").orderBy(shared.desc(), F.expr("chunk_index div 4 + 1"), F.round("score", 9).desc(), "doc_id", "chunk_index")
    return rows.select("query_id", "doc_id", "chunk_index", F.row_number().over(order).alias("place")).where("place <= 5")


@c.query(
    r"""WITH q AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS asked FROM conversations WHERE role = 'user')
SELECT conv_id, turn, asked FROM q WHERE asked <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, asked ORDER BY turn) = 1"""
)
def distinct_rounds(spark, sf_dir):
    """What a conversation asks, each question once, at its first round."""
    asked = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    rows = c.read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", asked.alias("asked")).where("asked <> ''")
    return rows.groupBy("conv_id", "asked").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "asked")


@c.query(
    f"""{c.CONTEXTS}, k AS (SELECT query_id, id, len({c.TERMS.format("query")}) AS n, len(list_filter({c.TERMS.format("query")}, lambda t: contains(lower(text), t))) AS s FROM x),
v AS (SELECT query_id, id, 2.0 * s - (n - s) + CASE WHEN s >= 0.6 * n THEN 1.5 WHEN s >= 0.3 * n THEN 0.5 ELSE -1.0 END AS score FROM k)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM v"""
)
def debate_rerank(spark, sf_dir):
    """The query's terms speak for a document that has them and against one that lacks them; their share is the verdict."""
    terms = T.query_terms(F.col("query"))
    rows = c.contexts(spark, sf_dir).select("query_id", "id", F.size(terms).alias("n"), F.size(F.filter(terms, lambda t: F.lower("text").contains(t))).alias("support"))
    verdict = F.when(F.col("support") >= 0.6 * F.col("n"), "keep").when(F.col("support") >= 0.3 * F.col("n"), "borderline").otherwise("drop")
    votes = rows.select("query_id", "id", "support", (F.col("n") - F.col("support")).alias("challenge"), verdict.alias("verdict"))
    return fusion.debated(votes).select("query_id", "id", "score", "place")


CLAUSES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.;!?])\s+', '\1' || chr(1), 'g'), '\n+|' || chr(1)), lambda x: trim(x, ' ;')), lambda x: x <> '')"


@c.query(f"WITH s AS (SELECT conv_id, turn, {CLAUSES} AS cs FROM conversations) SELECT conv_id, turn, CAST(unnest(range(len(cs))) AS INTEGER) AS n, unnest(cs) AS clause FROM s")
def clause_split(spark, sf_dir):
    return c.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(clauses(F.col("text"))).alias("n", "clause"))


@c.query(
    f"""WITH s AS (SELECT conv_id, turn, unnest({CLAUSES}) AS x FROM conversations), v AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE length(x) % 7 > 1) AS s, count(*) FILTER (WHERE length(x) % 7 = 1) AS x FROM s GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN s = 0 AND x > 0 THEN 'CONTRADICTED' WHEN s = 0 AND n > x THEN 'INSUFFICIENT' WHEN x > 0 THEN 'MIXED' ELSE 'SUPPORTED' END AS aggregate FROM v)
SELECT conv_id, turn, aggregate, round(s / n, 6) AS coverage, s / n >= 0.6 AND aggregate = 'SUPPORTED' AS kept FROM a"""
)
def abstention_gate(spark, sf_dir):
    """A clause's length stands in for a model's verdict."""
    n = F.length("clause") % 7
    votes = clause_split(spark, sf_dir).select("conv_id", "turn", F.when(n > 1, "SUPPORTED").when(n == 1, "CONTRADICTED").otherwise("INSUFFICIENT").alias("verdict"))
    return clause_gate(votes, ["conv_id", "turn"]).withColumn("coverage", F.round("coverage", 6))


def semantic_sql(first: int, spare: int = 0) -> str:
    """CTEs that end in h: contexts with the largest cosine of the query and one of their first sentences."""
    ss = f"{c.SENTENCES.format('text')}[1:{first}]"
    ss = f"CASE WHEN len({ss}) > 0 THEN {ss} ELSE [substr(text, 1, {spare})] END" if spare else ss
    return f"""h0 AS (SELECT query_id, query, id, text, score, rank, {BUCKETS.format("query")} AS qb, list_transform({ss}, lambda s: {BUCKETS.format("s")}) AS sb FROM x),
h1 AS (SELECT *, {EMBED.format("qb")} AS qv, list_transform(sb, lambda b: {EMBED.format("b")}) AS sv FROM h0),
h AS (SELECT *, list_max(list_transform(sv, lambda v: CASE WHEN list_sum(v) = 0 OR list_sum(qv) = 0 THEN 0.0 ELSE list_cosine_similarity(qv, v) END)) AS semantic FROM h1)"""


@c.query(
    f"""{c.CONTEXTS}, {semantic_sql(6)}
SELECT query_id, id, round(coalesce(semantic, -1), 6) AS best, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(semantic, -1), 9) DESC, round(score, 9) DESC, id) AS rank FROM h"""
)
def semantic_rerank(spark, sf_dir):
    return fusion.semantic_rerank(c.contexts(spark, sf_dir)).select("query_id", "id", F.round("best", 6).alias("best"), "rank")


YEAR = r"(^|[^\p{L}\p{N}_])[0-9]{4}($|[^\p{L}\p{N}_])"


@c.query(
    f"""{c.CONTEXTS}, {semantic_sql(4, 220)}, e AS (SELECT *, {c.TERMS.format("query")} AS terms, lower(text) AS hay, lower(query) AS low FROM h),
v AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(hay, t))) / len(terms) ELSE 0.0 END AS cov,
CASE WHEN regexp_matches(low, '^(who|whose)') THEN CASE WHEN regexp_matches(hay, '(^|[^\\p{{L}}\\p{{N}}_])[a-z]+ [a-z]+($|[^\\p{{L}}\\p{{N}}_])') THEN 0.25 ELSE 0 END WHEN regexp_matches(low, '^when') OR regexp_matches(low, '{YEAR}') THEN CASE WHEN regexp_matches(hay, '{YEAR}') THEN 0.25 ELSE 0 END
WHEN regexp_matches(low, '^where') THEN CASE WHEN regexp_matches(hay, ' in | at | city| country| state| province') THEN 0.25 ELSE 0 END WHEN regexp_matches(low, '^(is|was|were|did|does) ') THEN CASE WHEN regexp_matches(hay, 'yes|no|not|did|was') THEN 0.15 ELSE 0 END ELSE 0 END AS bonus FROM e),
w AS (SELECT query_id, id, text, rank, round(0.65 * coalesce(semantic, 0) + 0.25 * cov + bonus + CASE WHEN cov > 0 THEN 0.1 ELSE 0 END, 9) AS s, score FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY s DESC, round(score, 9) DESC, id) AS n, max(s) OVER (PARTITION BY query_id) > 0 AS hit FROM w),
o AS (SELECT query_id, id, CASE WHEN hit THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC, round(score, 9) DESC, id) ELSE rank END AS place FROM k WHERE NOT hit OR (s > 0 AND n = 1)) SELECT query_id, id, place AS rank FROM o WHERE place <= 5"""
)
def evidence_selection(spark, sf_dir):
    """0.65 of the likeness of the best of four sentences, 0.25 of coverage, 0.1 for any coverage, and the answer's kind; each text once."""
    return selected(c.contexts(spark, sf_dir), 5).select("query_id", "id", F.col("place").alias("rank"))


def selected(rows: DataFrame, k: int) -> DataFrame:
    """rows (query_id, query, id, text, score, rank) with place: the k best by evidence; where none scores above 0 the first k as they were."""
    cov = policy.coverage(T.query_terms(F.col("query")), F.col("text"))
    semantic = F.coalesce(embedding.best_sentence(F.col("query"), F.col("text"), 4, 220), F.lit(0.0))
    rows = rows.withColumn("__cov", cov).withColumn("__sem", semantic)
    s = 0.65 * F.col("__sem") + 0.25 * F.col("__cov") + answer_bonus(F.col("query"), F.lower("text")) + F.when(F.col("__cov") > 0, 0.1).otherwise(0.0)
    order = [F.desc("__s"), F.round("score", 9).desc(), "id"]
    own = Window.partitionBy("query_id")
    rows = rows.withColumn("__s", F.round(s, 9)).withColumn("__n", F.row_number().over(Window.partitionBy("query_id", F.sha2("text", 256)).orderBy(*order))).withColumn("__some", F.max("__s").over(own) > 0)
    rows = rows.where(~F.col("__some") | ((F.col("__s") > 0) & (F.col("__n") == 1)))
    place = F.when(F.col("__some"), F.row_number().over(own.orderBy(*order))).otherwise(F.col("rank"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= k).drop("__cov", "__sem", "__s", "__n", "__some")


# What marks a question about now; the context that answers it, and its score.
LIVE_CUES, LIVE_SCORE = [" today", " current", " currently", " now", " latest", " right now", " this year", " current year"], 10.0
LIVE_TITLE, LIVE_LINES = "Live operational state", ["LIVE_STATE:", "- UTC timestamp: {0}", "- UTC date: {1}", "- UTC year: {2}", "- Source: deterministic runtime clock", "- Triggered for query: "]


def live_contexts(queries: DataFrame, clock: str) -> DataFrame:
    """(query_id, id, title, text, score): a context that tells the time for each query (query_id, text) with a word about now.

    clock is the time as YYYY-MM-DDTHH:MM:SS+00:00, given by the caller so that results can be repeated.
    """
    head = "\n".join(LIVE_LINES).format(clock, clock[:10], clock[:4])
    asks = has(F.concat(F.lit(" "), "text", F.lit(" ")), LIVE_CUES)
    return queries.where(asks).select("query_id", F.lit(f"live:{clock[:10]}").alias("id"), F.lit(LIVE_TITLE).alias("title"), F.concat(F.lit(head), "text").alias("text"), F.lit(LIVE_SCORE).alias("score"))


@c.query(
    "SELECT conv_id || ':' || turn AS query_id, 'live:2025-01-01' AS id, 'Live operational state' AS title, concat_ws(chr(10), 'LIVE_STATE:', '- UTC timestamp: 2025-01-01T00:00:00+00:00', '- UTC date: 2025-01-01', '- UTC year: 2025', '- Source: deterministic runtime clock', '- Triggered for query: ' || q) AS text, 10.0::DOUBLE AS score "
    "FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'What is new today? ' ELSE '' END || text AS q FROM conversations) WHERE "
    + " OR ".join(f"contains(' ' || lower(q) || ' ', '{x}')" for x in LIVE_CUES)
)
def live_route(spark, sf_dir):
    """Every third turn is made to ask about today."""
    asked = F.concat(F.when(F.col("turn") % 3 == 0, "What is new today? ").otherwise(""), "text")
    q = c.read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), asked.alias("text"))
    return live_contexts(q, "2025-01-01T00:00:00+00:00")
