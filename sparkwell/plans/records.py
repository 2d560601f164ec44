"""Records and labels: table views of a text, profile alignment, structured responses, label and message normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T

# How many rows a table view reads and previews, and what columns its schema names by the number of rows.
ROWS, PREVIEWS = 8, 3
SCHEMA = ["subject", "relation", "detail"]
# Weights of entities, time constraints, expectations, and relation with intent.
WEIGHTS = (2.0, 1.2, 0.8, 0.6)


#: A year of the last two centuries, by itself.
YEARS = r"(?<![\p{L}\p{N}_])(?:19|20)\d{2}(?![\p{L}\p{N}_])"


def table_views(docs: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """(doc_id, view, row_index, content): a summary with previews, then each row of a text read as a table.

    A text without rows has a summary only; null counts as empty.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(title_col, F.lit("")).alias("title"), F.slice(T.sentences(F.coalesce(text_col, F.lit(""))), 1, ROWS).alias("rows"))
    named = F.array_join(F.slice(F.array(*map(F.lit, SCHEMA)), F.lit(1), F.greatest(F.lit(1), F.least(F.size("rows"), F.lit(len(SCHEMA))))), " | ")
    previews = F.transform(F.slice("rows", 1, PREVIEWS), lambda r, i: F.concat(F.lit("ROW_PREVIEW_"), (i + 1).cast("string"), F.lit(": "), r))
    head = F.concat(F.lit("TABLE_SUMMARY\nTITLE: "), "title", F.lit("\nTABLE_SCHEMA: "), named, F.lit("\nROW_COUNT: "), F.size("rows").cast("string"), F.lit("\n"))
    summary = F.struct(F.lit("table_summary").alias("view"), F.lit(None).cast("int").alias("row_index"), F.concat(head, F.array_join(previews, "\n")).alias("content"))
    row = lambda r, i: F.struct(F.lit("table_row").alias("view"), i.alias("row_index"), F.concat(F.lit("TABLE_ROW\nTITLE: "), "title", F.lit("\nROW_INDEX: "), i.cast("string"), F.lit("\nROW_TEXT: "), r).alias("content"))
    return base.select("doc_id", F.explode(F.concat(F.array(summary), F.transform("rows", row))).alias("r")).select("doc_id", "r.*")


def overlap(needles: Column, haystack: Column) -> Column:
    """Share of the needles that the haystack contains, in either case; 0 without needles."""
    found = F.size(F.filter(needles, lambda n: F.lower(haystack).contains(F.lower(n))))
    return F.when(F.size(needles) > 0, found / F.size(needles)).otherwise(F.lit(0.0))


def alignment(haystack: Column, entities: Column, times: Column, expectations: Column, relation: Column) -> Column:
    """What a profile adds to a context's score."""
    parts = [F.lit(w) * overlap(n, haystack) for w, n in zip(WEIGHTS, (entities, times, expectations, relation))]
    return parts[0] + parts[1] + parts[2] + parts[3]


def response_json(text: Column) -> Column:
    """The JSON object of a response: fenced, else from the first brace to the last, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(text)


def parsed_answer(text: Column) -> Column:
    """The answer of a response; bad JSON is itself the answer."""
    j = response_json(text)
    return F.when(F.get_json_object(j, "$").isNull(), T.strip(j)).otherwise(F.coalesce(F.get_json_object(j, "$.answer"), F.lit("")))


def parsed_facts(text: Column) -> Column:
    """Pairs of title and sentence; titles lose folders and .txt, other shapes go, bad JSON has none."""
    kind = "array<array<string>>"
    facts = F.from_json(F.get_json_object(response_json(text), "$.supporting_facts"), kind)
    pairs = F.filter(facts, lambda f: F.size(f) == 2)
    return F.coalesce(F.transform(pairs, lambda f: F.array(F.regexp_replace(F.regexp_replace(f[0], "(?s)^.*/", ""), r"\.txt$", ""), f[1])), F.array().cast(kind))


def sentence_index(lines: Column, sentence: Column, strict: bool = True) -> Column:
    """Place, from 0, of the first line that equals the sentence or holds it or is held; -1 if none.

    Unless strict, a blank line is held by any sentence.
    """
    s = T.strip(sentence)
    fits = lambda x: (T.strip(x) == s) | x.contains(s) | s.contains(T.strip(x))
    hit = F.transform(lines, lambda x: F.when((T.strip(x) != "") | F.lit(not strict), fits(x)).otherwise(False))
    return F.array_position(hit, F.lit(True)).cast("int") - 1


def task_label(label: Column, fallback: str) -> Column:
    found = T.strip(F.coalesce(label, F.lit("")))
    return F.when(found == "", fallback).otherwise(found)


def multi_turn_label(label: Column) -> Column:
    low = F.lower(task_label(label, "unknown"))
    return F.when(low.isin("follow up", "follow-up"), "Follow-up").when(low == "clarification", "Clarification").when(low.isin("n/a", "na"), "N/A").otherwise(low)


def query_text(text: Column) -> Column:
    """Lines without speaker marks and blanks."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: T.strip(F.regexp_replace(T.strip(x), r"^\|(user|assistant|agent)\|:", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@c.query(
    r"""WITH l AS (SELECT conv_id, turn, list_transform(string_split('|' || role || '|: ' || text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^\|(user|assistant|agent)\|:', ''))) AS ls FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)) AS asked FROM l"""
)
def clean_queries(spark, sf_dir):
    """Turns with a speaker's mark in front, as files of queries have them, without it and without blank lines."""
    marked = F.concat(F.lit("|"), "role", F.lit("|: "), "text")
    return c.read(spark, sf_dir, "conversations").select("conv_id", "turn", query_text(marked).alias("asked"))


def messages(turns: DataFrame, role_col: str, text_col: str) -> DataFrame:
    """The turns of users and assistants that say something, roles named alike."""
    who = T.strip(F.lower(role_col))
    role = F.when(who == "user", "user").when(who.isin("agent", "assistant"), "assistant")
    return turns.withColumn(role_col, role).withColumn(text_col, T.strip(F.col(text_col))).where(F.col(role_col).isNotNull() & (F.col(text_col) != ""))


@c.query(
    f"""WITH s AS (SELECT doc_id, coalesce(source, '') AS t, ({c.SENTENCES.format("coalesce(text, '')")})[1:8] AS r FROM documents)
SELECT doc_id, 'table_summary' AS view, CAST(NULL AS INTEGER) AS row_index, 'TABLE_SUMMARY' || chr(10) || 'TITLE: ' || t || chr(10) || 'TABLE_SCHEMA: ' || CASE WHEN len(r) > 2 THEN 'subject | relation | detail' WHEN len(r) = 2 THEN 'subject | relation' ELSE 'subject' END
|| chr(10) || 'ROW_COUNT: ' || len(r) || chr(10) || coalesce(array_to_string(list_transform(range(1, least(len(r), 3) + 1), lambda i: 'ROW_PREVIEW_' || i || ': ' || r[i]), chr(10)), '') AS content FROM s
UNION ALL SELECT doc_id, 'table_row', CAST(i - 1 AS INTEGER), 'TABLE_ROW' || chr(10) || 'TITLE: ' || t || chr(10) || 'ROW_INDEX: ' || (i - 1) || chr(10) || 'ROW_TEXT: ' || r[i] FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM s)"""
)
def table_view_records(spark, sf_dir):
    return table_views(c.read(spark, sf_dir, "documents"), "doc_id", "source", "text")


@c.query(
    f"""WITH {c.DOC_BM25}, {c.top_sql("m", 20, "t")}, q AS (SELECT item_id AS query_id, {c.TERMS.format("text")} AS ts FROM benchmark),
b AS (SELECT t.query_id, t.id, 2.0::DOUBLE * CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda x: contains(lower(d.text), x)))::DOUBLE / len(ts) ELSE 0 END + 0.0
+ 0.6::DOUBLE * (len(list_filter([coalesce(list_min(ts), ''), ''], lambda x: contains(lower(d.text), x)))::DOUBLE / 2) AS bonus FROM t JOIN q ON t.query_id = q.query_id JOIN documents d ON d.doc_id = t.id)
SELECT query_id, id, round(bonus, 6) AS bonus, row_number() OVER (PARTITION BY query_id ORDER BY round(bonus, 6) DESC, id) AS place FROM b"""
)
def profile_alignment(spark, sf_dir):
    """Profile: the query's terms as entities, the alphabet's first of them as relation, no intent, times or expectations."""
    profiles = c.questions(spark, sf_dir).select("query_id", T.query_terms(F.col("text")).alias("ts"))
    texts = c.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    none = F.array().cast("array<string>")
    relation = F.array(F.coalesce(F.array_min("ts"), F.lit("")), F.lit(""))
    bonus = F.round(alignment(F.col("text"), F.col("ts"), none, none, relation), 6)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bonus"), "id"))
    return c.doc_hits(spark, sf_dir).join(profiles, "query_id").join(texts, "id").select("query_id", "id", bonus.alias("bonus")).withColumn("place", place.cast("long"))


@c.query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN '{"answer": ' || n_name ELSE n_name END AS answer, CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE 1 END AS n_facts,
CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS title FROM nation"""
)
def response_parse(spark, sf_dir):
    """Responses that are fenced, bare within prose, or broken; each good one has one fact and one of a wrong shape."""
    good = F.concat(F.lit('{"answer": "'), "n_name", F.lit('", "supporting_facts": [["files/'), "n_name", F.lit('.txt", "A line."], ["odd"]]}'))
    kind = F.col("n_nationkey") % 3
    said = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("So "), good, F.lit(" it is."))).otherwise(F.concat(F.lit('{"answer": '), "n_name"))
    rows = c.read(spark, sf_dir, "nation").select("n_nationkey", said.alias("said"))
    facts = parsed_facts(F.col("said"))
    return rows.select("n_nationkey", parsed_answer(F.col("said")).alias("answer"), F.size(facts).alias("n_facts"), F.get(F.get(facts, F.lit(0)), F.lit(0)).alias("title"))


@c.query("SELECT n_nationkey, ['Follow-up', 'Clarification', 'N/A', 'unknown', lower(n_name)][n_nationkey % 5 + 1] AS label FROM nation")
def multi_turn_labels(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(" Follow UP"), F.lit("clarification"), F.lit("NA"), F.lit(" "), F.col("n_name")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return c.read(spark, sf_dir, "nation").select("n_nationkey", multi_turn_label(raw).alias("label"))


@c.query(f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, {c.STRIP.format('text')} AS text FROM conversations WHERE role IN ('user', 'agent', 'assistant') AND {c.STRIP.format('text')} <> ''")
def chat_messages(spark, sf_dir):
    return messages(c.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "role", "text")


def shortened(text: Column, most: int) -> Column:
    """The text with single spaces, cut to `most` characters, the last three of which are then dots."""
    t = T.squeeze(text)
    return F.when(F.length(t) > most, F.concat(F.substr(t, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(t)


def or_all(hits: DataFrame, keep: Column) -> DataFrame:
    """The rows of a query that fit, or all of them where none does."""
    some = F.max(F.coalesce(keep, F.lit(False))).over(Window.partitionBy("query_id"))
    return hits.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("__some", some).where("__keep or not __some").drop("__keep", "__some")


def meets_constraints(haystack: Column, entities: Column, times: Column, strict: bool) -> Column:
    """An entity and a time are found; not strictly, one of the two is enough.  What isn't asked for counts as met."""
    entity = (F.size(entities) == 0) | (overlap(entities, haystack) > 0)
    time = (F.size(times) == 0) | (overlap(times, haystack) > 0)
    return entity & time if strict else entity | time


def free_of_conflict(text: Column, years: Column) -> Column:
    """The text names none but one of the years, or no year at all, or no years are asked for."""
    named = F.regexp_extract_all(text, F.lit(YEARS), F.lit(0))
    return (F.size(years) == 0) | (F.size(named) == 0) | F.arrays_overlap(named, years)


def best_clusters(hits: DataFrame, cluster: str, score: str, clusters: int, each: int = 2) -> DataFrame:
    """hits with place: `each` best of each query's best clusters, as the best of a cluster ranks it."""
    within = F.row_number().over(Window.partitionBy("query_id", cluster).orderBy(F.desc(score), "id"))
    best = F.max(score).over(Window.partitionBy("query_id", cluster))
    ranked = hits.withColumn("__in", within).withColumn("__best", best).where(F.col("__in") <= each)
    ranked = ranked.withColumn("__c", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("__best"), cluster))).where(F.col("__c") <= clusters)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))
    return ranked.withColumn("place", place.cast("long")).drop("__in", "__best", "__c")


@c.query(f"WITH s AS (SELECT doc_id, {c.SQUEEZE.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 220 THEN substr(t, 1, 217) || '...' ELSE t END AS short, CASE WHEN length(t) > 900 THEN substr(t, 1, 897) || '...' ELSE t END AS long FROM s")
def context_truncate(spark, sf_dir):
    text = F.col("text")
    return c.read(spark, sf_dir, "documents").select("doc_id", shortened(text, 220).alias("short"), shortened(text, 900).alias("long"))


@c.query(
    f"""WITH {c.DOC_BM25}, {c.top_sql("m", 20, "t")}, q AS (SELECT item_id AS query_id, list_max({c.TERMS.format("text")}) AS e, list_min({c.TERMS.format("text")}) AS f FROM benchmark),
k AS (SELECT t.query_id, t.id, (e IS NULL OR contains(lower(d.text), e)) AND (f IS NULL OR contains(lower(d.text), f)) AS s, e IS NULL OR contains(lower(d.text), e) OR f IS NULL OR contains(lower(d.text), f) AS l
FROM t JOIN q ON t.query_id = q.query_id JOIN documents d ON d.doc_id = t.id)
SELECT query_id, id, 'strict' AS mode FROM (SELECT *, bool_or(s) OVER (PARTITION BY query_id) AS o FROM k) WHERE s OR NOT o
UNION ALL SELECT query_id, id, 'lenient' FROM (SELECT *, bool_or(l) OVER (PARTITION BY query_id) AS o FROM k) WHERE l OR NOT o"""
)
def constraint_filter(spark, sf_dir):
    """The alphabet's last query term stands for the entity, its first for the time."""
    ts = T.query_terms(F.col("text"))
    one = lambda t: F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(t))
    profiles = c.questions(spark, sf_dir).select("query_id", one(F.array_max(ts)).alias("e"), one(F.array_min(ts)).alias("f"))
    texts = c.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    rows = c.doc_hits(spark, sf_dir).select("query_id", "id").join(profiles, "query_id").join(texts, "id")
    parts = [or_all(rows, meets_constraints(F.col("body"), F.col("e"), F.col("f"), mode == "strict")).select("query_id", "id", F.lit(mode).alias("mode")) for mode in ("strict", "lenient")]
    return parts[0].unionByName(parts[1])


@c.query(
    f"""WITH {c.DOC_BM25}, {c.top_sql("m", 20, "t")}, r AS (SELECT t.query_id, t.id, coalesce(d.source, '') AS cluster, -t.rank AS s FROM t JOIN documents d ON d.doc_id = t.id),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, cluster ORDER BY s DESC, id) AS n, max(s) OVER (PARTITION BY query_id, cluster) AS b FROM r),
k AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY b DESC, cluster) AS c FROM w WHERE n <= 2)
SELECT query_id, id, cluster, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM k WHERE c <= 5"""
)
def context_clusters(spark, sf_dir):
    texts = c.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("cluster"))
    rows = c.doc_hits(spark, sf_dir).join(texts, "id").select("query_id", "id", "cluster", (-F.col("rank")).alias("s"))
    return best_clusters(rows, "cluster", "s", 5).select("query_id", "id", "cluster", "place")
