"""Reflection and critique around a model's texts: tables of actions drive rounds for each query on its own, and drafts are licensed clause by clause.

A provider gives columns: reflect, draft, critique, revise and license.  `Reader` is one by rules, for tests and for runs without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell import storage
from sparkwell.functions import text as T
from sparkwell.operators import policy
from sparkwell.plans import hybrid, rounds
from sparkwell.plans.sessions import years

# What a controller may say, what a critic says of a draft, and what an answer without licence is.
MORE, USE, ANSWER = "retrieve_more", "use_current_evidence", "answer_now"
GOOD, BAD = "GOOD", "BAD"
RELEVANCE, MAPPING, SYNTHESIS = "relevance", "mapping", "synthesis"
SUPPORTED, CONTRADICTED, INSUFFICIENT, MIXED = "SUPPORTED", "CONTRADICTED", "INSUFFICIENT", "MIXED"
NO_EVIDENCE = "INSUFFICIENT_EVIDENCE"
# How many contexts a controller sees, and how much of each.
SEEN, SEEN_CHARS = 5, 280


class Reader:
    """Looks for a question's terms in the evidence."""

    def missing(self, question: Column, evidence: Column) -> Column:
        return F.filter(T.query_terms(question), lambda t: ~F.lower(evidence).contains(t))

    def share(self, text: Column, evidence: Column) -> Column:
        """Share of a text's terms that the evidence has; 1 for a text without any."""
        terms = T.query_terms(text)
        return F.when(F.size(terms) > 0, policy.coverage(terms, evidence)).otherwise(1.0)

    def reflect(self, question: Column, evidence: Column) -> tuple[Column, Column]:
        """(action, query): more where under 0.6 of the terms are found, by those that aren't; an answer where all are."""
        share = F.round(self.share(question, evidence), 9)
        gone = F.array_join(self.missing(question, evidence), " ")
        return F.when(share < 0.6, MORE).when(share < 1, USE).otherwise(ANSWER), F.when(share < 0.6, gone).otherwise("")

    def draft(self, question: Column, first: Column) -> Column:
        """The first two sentences of the best context, after the question as a claim."""
        return F.array_join(F.concat(F.array(F.concat(F.regexp_replace(question, r"[?\s]+$", ""), F.lit("."))), F.slice(T.sentences(F.coalesce(first, F.lit(""))), 1, 2)), " ")

    def license(self, clause: Column, evidence: Column) -> Column:
        """SUPPORTED with 0.6 of a clause's terms; CONTRADICTED where its years are others than the evidence's."""
        own, told = years(clause), years(evidence)
        against = (F.size(own) > 0) & (F.size(told) > 0) & ~F.arrays_overlap(own, told)
        return F.when(against, CONTRADICTED).when(F.round(self.share(clause, evidence), 9) >= 0.6, SUPPORTED).otherwise(INSUFFICIENT)

    def critique(self, question: Column, draft: Column, evidence: Column) -> tuple[Column, Column, Column]:
        """(unsupported clauses, missing facts, bridge query)."""
        unsupported = F.filter(hybrid.clauses(draft), lambda x: self.license(x, evidence) != SUPPORTED)
        missing = self.missing(question, evidence)
        return unsupported, missing, F.array_join(missing, " ")

    def revise(self, question: Column, draft: Column, evidence: Column) -> Column:
        """The draft's supported clauses."""
        return F.array_join(F.filter(hybrid.clauses(draft), lambda x: self.license(x, evidence) == SUPPORTED), " ")


Retrieve = Callable[[DataFrame], DataFrame]


def evidence(contexts: DataFrame, most: int = SEEN, chars: int = SEEN_CHARS) -> DataFrame:
    """(query_id, evidence, first) of contexts (query_id, place, text): the first ones' beginnings, a line each, and the whole first."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    rows = contexts.where(F.col("place") <= most).groupBy("query_id").agg(parts.alias("p"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: F.substring(F.coalesce(x["text"], F.lit("")), 1, chars)), "\n").alias("evidence"), F.coalesce(F.get("p", F.lit(0))["text"], F.lit("")).alias("first"))


def in_order(found: DataFrame) -> DataFrame:
    """found (query_id, round, id, text, rank) with each id once, placed by first appearance."""
    once = found.groupBy("query_id", "id").agg(F.min(F.struct("round", "rank", "text")).alias("f"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("f.round", "f.rank", "id"))
    return once.select("query_id", "id", F.col("f.text").alias("text"), place.alias("place"))


def reflected(queries: DataFrame, retrieve: Retrieve, provider, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(actions, contexts) of queries (query_id, text).

    actions (query_id, round, asked, action, query): after each round the provider sees the evidence so far and says whether to
    retrieve more, by which query; a query that doesn't, or would ask what it has asked before, is done.  contexts (query_id, id, text, place).
    """
    asked = queries.select("query_id", F.col("text").alias("question"), F.col("text").alias("asked"), F.array("text").alias("before"))
    found, actions = None, None
    for n in range(most):
        rows = retrieve(asked.select("query_id", F.col("asked").alias("text"))).select("query_id", F.lit(n).alias("round"), "id", "text", "rank")
        found = storage.written(rows if found is None else found.unionByName(rows), "critique-found")
        seen = asked.join(evidence(in_order(found)), "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
        action, query = provider.reflect(F.col("question"), F.col("evidence"))
        said = storage.written(seen.select("query_id", F.lit(n).alias("round"), "question", "asked", "before", action.alias("action"), query.alias("query")), "critique-said")
        step = said.select("query_id", "round", "asked", "action", "query")
        actions = step if actions is None else actions.unionByName(step)
        more = (F.col("action") == MORE) & (F.col("query") != "") & ~F.array_contains("before", F.col("query"))
        asked = said.where(more).select("query_id", "question", F.col("query").alias("asked"), F.array_append("before", F.col("query")).alias("before"))
    return actions, in_order(found)


def critiqued(queries: DataFrame, contexts: DataFrame, retrieve: Retrieve, provider) -> DataFrame:
    """(query_id, draft, verdict, failure, bridge, answer) of queries (query_id, text) with contexts (query_id, id, text, place).

    A draft whose clauses all have support, with no fact missing, is GOOD and stays.  Others fail by mapping where a bridge query is known, by
    synthesis where only claims lack support, else by relevance; mapping and relevance retrieve by the bridge, or the question,
    before the draft is revised over all contexts.  An empty revision leaves the draft.
    """
    rows = queries.select("query_id", F.col("text").alias("question")).join(evidence(contexts), "query_id", "left").fillna("", ["evidence", "first"])
    rows = rows.withColumn("draft", provider.draft(F.col("question"), F.col("first")))
    unsupported, missing, bridge = provider.critique(F.col("question"), F.col("draft"), F.col("evidence"))
    rows = rows.withColumn("unsupported", unsupported).withColumn("missing", missing).withColumn("bridge", bridge)
    fine = (F.size("unsupported") == 0) & (F.size("missing") == 0)
    failure = F.when(fine, "").when(F.col("bridge") != "", MAPPING).when(F.size("unsupported") > 0, SYNTHESIS).otherwise(RELEVANCE)
    rows = storage.written(rows.withColumn("verdict", F.when(fine, GOOD).otherwise(BAD)).withColumn("failure", failure), "critique-drafts")
    again = rows.where(F.col("failure").isin(MAPPING, RELEVANCE)).select("query_id", F.when(F.col("bridge") != "", F.col("bridge")).otherwise(F.col("question")).alias("text"))
    extra = retrieve(again).select("query_id", F.lit(1).alias("round"), "id", "text", "rank")
    whole = in_order(contexts.select("query_id", F.lit(0).alias("round"), "id", "text", F.col("place").alias("rank")).unionByName(extra))
    told = evidence(whole, most=2 * SEEN).select("query_id", F.col("evidence").alias("whole"))
    rows = rows.join(told, "query_id", "left").withColumn("whole", F.coalesce("whole", F.lit("")))
    revised = provider.revise(F.col("question"), F.col("draft"), F.col("whole"))
    answer = F.when(F.col("verdict") == GOOD, F.col("draft")).otherwise(T.first_filled(revised, F.col("draft")))
    return rows.select("query_id", "draft", "verdict", "failure", "bridge", answer.alias("answer"))


def licensed(clauses: DataFrame, mode: str) -> DataFrame:
    """(query_id, aggregate, coverage, answer) of clauses (query_id, n, clause, verdict) and the draft (draft) that they come from.

    mode "supported": what is supported, or the draft; "covered": what is supported if that is 0.6 of the clauses and nothing speaks against it;
    "mixed": what is supported, also beside contradicted clauses.  An answer that isn't licensed is NO_EVIDENCE.
    """
    part = F.struct("n", "clause")
    rows = clauses.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == SUPPORTED, part))).alias("s"), F.count_if(F.col("verdict") == CONTRADICTED).alias("x"), F.count_if(F.col("clause").isNotNull()).alias("n"), F.first("draft").alias("draft")
    )
    none, others = F.size("s") == 0, F.col("n") - F.size("s") - F.col("x")
    name = F.when(none & (F.col("x") > 0), CONTRADICTED).when(none & (others > 0), INSUFFICIENT).when(F.col("x") > 0, MIXED).otherwise(SUPPORTED)
    text, coverage = F.array_join(F.transform("s", lambda x: x["clause"]), "; "), F.size("s") / F.greatest("n", F.lit(1))
    rows = rows.withColumn("aggregate", name).withColumn("told", text).withColumn("coverage", coverage)
    some = F.col("told") != ""
    answer = {
        "supported": F.when(some, F.col("told")).otherwise(F.col("draft")),
        "covered": F.when(some & (F.col("coverage") >= 0.6) & (F.col("aggregate") == SUPPORTED), F.col("told")).otherwise(NO_EVIDENCE),
        "mixed": F.when(F.col("aggregate") == SUPPORTED, F.when(some, F.col("told")).otherwise(F.col("draft"))).when((F.col("aggregate") == MIXED) & some, F.col("told")).otherwise(NO_EVIDENCE),
    }[mode]
    return rows.select("query_id", "aggregate", "coverage", answer.alias("answer"))


def judged(drafts: DataFrame, provider) -> DataFrame:
    """(query_id, n, clause, verdict, draft) of drafts (query_id, draft, evidence); a draft without clauses is one."""
    parts = hybrid.clauses(F.col("draft"))
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(T.strip(F.col("draft"))))
    rows = drafts.select("query_id", "draft", "evidence", F.posexplode(whole).alias("n", "clause"))
    return rows.select("query_id", "n", F.when(F.col("clause") != "", F.col("clause")).alias("clause"), provider.license(F.col("clause"), F.col("evidence")).alias("verdict"), "draft")


# Queries


def answered(spark, sf_dir) -> tuple[DataFrame, DataFrame, Retrieve]:
    """(queries, contexts of one search, how to search)."""
    q, find = c.questions(spark, sf_dir), rounds.lexical(spark, sf_dir, 5)
    hits = storage.written(find(q), "answered")
    return q, hits.select("query_id", "id", "text", F.col("rank").alias("place")), find


@c.query()
def reflection_actions(spark, sf_dir):
    return reflected(c.questions(spark, sf_dir), rounds.lexical(spark, sf_dir, 5), Reader())[0]


@c.query()
def critique_answers(spark, sf_dir):
    q, contexts, find = answered(spark, sf_dir)
    return critiqued(q, contexts, find, Reader())


def drafts(spark, sf_dir) -> DataFrame:
    q, contexts, _ = answered(spark, sf_dir)
    rows = q.select("query_id", F.col("text").alias("question")).join(evidence(contexts), "query_id", "left").fillna("", ["evidence", "first"])
    return rows.select("query_id", Reader().draft(F.col("question"), F.col("first")).alias("draft"), "evidence")


SHARE = f"CASE WHEN len({{0}}) > 0 THEN len(list_filter({{0}}, lambda t: contains(lower(evidence), t))) / len({{0}}) ELSE 1.0 END"
YEARS = r"regexp_extract_all(regexp_replace({}, '[^\x00-\x7F]', '_', 'g'), '\b(?:19|20)[0-9]{{2}}\b')"
LICENSED = f"""WITH {c.DOC_BM25}, {c.top_sql("m", 5, "t")}, ev AS (SELECT t.query_id, string_agg(substr(coalesce(text, ''), 1, 280), chr(10) ORDER BY rank) AS evidence, arg_min(coalesce(text, ''), rank) AS first FROM t JOIN documents ON doc_id = t.id GROUP BY 1),
dr AS (SELECT item_id AS query_id, coalesce(evidence, '') AS evidence, array_to_string([regexp_replace(text, '[?\\s]+$', '') || '.'] || ({c.SENTENCES.format("coalesce(first, '')")})[1:2], ' ') AS draft FROM benchmark LEFT JOIN ev ON query_id = item_id),
cl AS (SELECT query_id, draft, evidence, {hybrid.CLAUSES.replace("text", "draft")} AS cs FROM dr), cw AS (SELECT query_id, draft, evidence, CASE WHEN len(cs) > 0 THEN cs ELSE [{c.STRIP.format("draft")}] END AS cs FROM cl),
ce1 AS (SELECT query_id, draft, evidence, unnest(range(len(cs))) AS n, unnest(cs) AS clause FROM cw), cy AS (SELECT *, {c.TERMS.format("clause")} AS ts, {YEARS.format("clause")} AS own, {YEARS.format("evidence")} AS told FROM ce1),
cv AS (SELECT query_id, draft, n, clause, CASE WHEN len(own) > 0 AND len(told) > 0 AND NOT list_has_any(own, told) THEN 'CONTRADICTED' WHEN round({SHARE.format("ts")}, 9) >= 0.6 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS verdict FROM cy),
ca AS (SELECT query_id, any_value(draft) AS draft, count(*) FILTER (verdict = 'SUPPORTED') AS s, count(*) FILTER (verdict = 'CONTRADICTED') AS x, count(*) AS n, coalesce(string_agg(clause, '; ' ORDER BY n) FILTER (verdict = 'SUPPORTED'), '') AS told FROM cv GROUP BY 1),
cb AS (SELECT *, CASE WHEN s = 0 AND x > 0 THEN 'CONTRADICTED' WHEN s = 0 AND n > x THEN 'INSUFFICIENT' WHEN x > 0 THEN 'MIXED' ELSE 'SUPPORTED' END AS aggregate FROM ca)"""


@c.query(f"{LICENSED} SELECT query_id, CAST(n AS INTEGER) AS n, clause, verdict FROM cv")
def clause_verdicts(spark, sf_dir):
    return judged(drafts(spark, sf_dir), Reader()).select("query_id", "n", "clause", "verdict")


@c.query(
    f"""{LICENSED} SELECT query_id, 'supported' AS mode, aggregate, CASE WHEN told <> '' THEN told ELSE draft END AS answer FROM cb
UNION ALL SELECT query_id, 'covered', aggregate, CASE WHEN told <> '' AND s / n >= 0.6 AND aggregate = 'SUPPORTED' THEN told ELSE 'INSUFFICIENT_EVIDENCE' END FROM cb
UNION ALL SELECT query_id, 'mixed', aggregate, CASE WHEN aggregate = 'SUPPORTED' THEN CASE WHEN told <> '' THEN told ELSE draft END WHEN aggregate = 'MIXED' AND told <> '' THEN told ELSE 'INSUFFICIENT_EVIDENCE' END FROM cb"""
)
def licensed_answers(spark, sf_dir):
    """Answers of which only the clauses that the evidence bears out are said, in three degrees of strictness."""
    votes = storage.written(judged(drafts(spark, sf_dir), Reader()), "votes")
    parts = [licensed(votes, mode).select("query_id", F.lit(mode).alias("mode"), "aggregate", "answer") for mode in ("supported", "covered", "mixed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
