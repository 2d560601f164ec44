"""Reports on answers: corpus means over all gold rows, accuracy, counters, gold ids, conversations, and parsers of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T
from sparkwell.operators import metrics


def corpus_means(gold: DataFrame, scores: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """One row: n and the mean of each score over all of gold; a gold row without scores counts as 0."""
    rows = gold.select(key).join(scores.select(*key, *names), key, "left")
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(n, F.lit(0.0))).alias(n) for n in names))


def accuracy(rows: DataFrame, correct: Column, seconds: Column) -> DataFrame:
    """One row: n, correct, accuracy, the sum and the mean of seconds; an unknown result is wrong."""
    return rows.agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("accuracy"), F.sum(seconds).alias("seconds"), F.avg(seconds).alias("mean_seconds"))


def counters(rows: DataFrame, **when: Column) -> DataFrame:
    """One row: how many rows there are, and how many of each kind."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(x).alias(n) for n, x in when.items()))


def gold_id(raw: Column) -> Column:
    """The short hash by which passages are known."""
    return F.substring(F.sha2(F.encode(raw, "UTF-8"), 256), 1, 16)


def relevant_ids(tasks: DataFrame, contexts: str = "contexts") -> DataFrame:
    """(query_id, gold_id) of tasks (query_id, contexts): the short hashes of contexts that are marked as a reference, each once.

    A context is a struct of document_id, id and reference; id stands in for a document_id that is null, and a context without either goes.
    """
    rows = tasks.select("query_id", F.explode(contexts).alias("x")).where(F.coalesce(F.col("x.reference"), F.lit(False)))
    raw = F.coalesce(F.col("x.document_id"), F.col("x.id"))
    return rows.where(raw != "").select("query_id", gold_id(raw).alias("gold_id")).distinct()


def decision(notes: Column) -> Column:
    """What the last judge decided, as notes have it; empty if they don't."""
    return F.regexp_extract(notes, r"final judge decision=(\w+)", 1)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, role, text)."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


NAMES = ["em", "f1", "sp_em", "sp_f1", "joint_em", "joint_f1"]


@c.query(
    f"""WITH {c.STRICT}, w AS (SELECT turn % 4 = 0 AS no_answer, turn % 7 = 0 AS no_facts, em, none, CASE WHEN none THEN 0.0 ELSE c / len(a) END AS p, CASE WHEN none THEN 0.0 ELSE c / len(b) END AS r, CASE WHEN none THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END AS f1,
CASE WHEN n = 0 THEN 0.0 ELSE h / n END AS fp, CASE WHEN m = 0 THEN 0.0 ELSE h / m END AS fr, CAST(h = n AND h = m AS DOUBLE) AS fem FROM z1),
x AS (SELECT *, CASE WHEN p * fp + r * fr > 0 THEN 2 * p * fp * r * fr / (p * fp + r * fr) ELSE 0.0 END AS jf FROM w)
SELECT count(*) AS n, round(sum(CASE WHEN no_answer THEN 0 ELSE em END) / count(*), 6) AS em, round(sum(CASE WHEN no_answer THEN 0 ELSE f1 END) / count(*), 6) AS f1, round(sum(CASE WHEN no_facts THEN 0 ELSE fem END) / count(*), 6) AS sp_em,
round(sum(CASE WHEN no_facts OR fp + fr = 0 THEN 0 ELSE 2 * fp * fr / (fp + fr) END) / count(*), 6) AS sp_f1, round(sum(CASE WHEN no_answer OR no_facts THEN 0 ELSE em * fem END) / count(*), 6) AS joint_em, round(sum(CASE WHEN no_answer OR no_facts THEN 0 ELSE jf END) / count(*), 6) AS joint_f1 FROM x"""
)
def hotpot_report(spark, sf_dir):
    """Means over all gold turns; every fourth has no predicted answer, every seventh no facts."""
    gold = c.pairs(spark, sf_dir)
    em, p, r, f1 = metrics.strict_scores(F.col("pred"), F.col("gold"))
    fp, fr, ff, fem = metrics.fact_scores(T.answer_tokens(F.col("pred")), T.answer_tokens(F.col("gold")))
    answered, cited = F.col("turn") % 4 != 0, F.col("turn") % 7 != 0
    jp, jr = p * fp, r * fr
    scores = gold.where(answered | cited).select(
        "conv_id", "turn", *(F.when(answered, x).alias(n) for n, x in (("em", em), ("f1", f1))), *(F.when(cited, x).alias(n) for n, x in (("sp_em", fem), ("sp_f1", ff))), F.when(answered & cited, em * fem).alias("joint_em"), F.when(answered & cited, metrics.ratio(2 * jp * jr, jp + jr)).alias("joint_f1")
    )
    return corpus_means(gold, scores, ["conv_id", "turn"], NAMES).select("n", *(F.round(n, 6).alias(n) for n in NAMES))


@c.query(
    f"""WITH m AS ({c.ORACLE["finqa_match"]}) SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy, round(sum(o_custkey % 10 / 2), 4) AS seconds, round(avg(o_custkey % 10 / 2), 6) AS mean_seconds FROM m JOIN orders USING (o_orderkey)"""
)
def finqa_accuracy(spark, sf_dir):
    rows = c.QUERIES["finqa_match"](spark, sf_dir).join(c.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    out = accuracy(rows, F.col("ok"), F.col("o_custkey") % 10 / 2)
    return out.select("n", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("seconds", 4).alias("seconds"), F.round("mean_seconds", 6).alias("mean_seconds"))


@c.query(
    f"""WITH {c.DOC_BM25}, h AS (SELECT query_id, count(*) AS hits FROM m GROUP BY 1), g AS (SELECT item_id, item_id % 3 AS gold, coalesce(hits, 0) AS hits FROM benchmark LEFT JOIN h ON query_id = item_id)
SELECT count(*) AS rows, count(*) FILTER (WHERE gold > 0) AS scorable, count(*) FILTER (WHERE gold = 0) AS without_gold, count(*) FILTER (WHERE hits = 0) AS zero_context, count(*) FILTER (WHERE gold > 0 AND hits = 0) AS zero_hit FROM g"""
)
def retrieval_counters(spark, sf_dir):
    """Questions with and without gold labels (two thirds have some), and with and without hits."""
    q = c.questions(spark, sf_dir)
    found = c.doc_hits(spark, sf_dir, 1).select("query_id").distinct().withColumn("hit", F.lit(True))
    rows = q.join(found, "query_id", "left").select((F.col("query_id") % 3 > 0).alias("gold"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return counters(rows, scorable=F.col("gold"), without_gold=~F.col("gold"), zero_context=~F.col("hit"), zero_hit=F.col("gold") & ~F.col("hit"))


@c.query(f"WITH {c.F1} SELECT conv_id, turn, CAST(a = b AS DOUBLE) AS em, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(a = b AS DOUBLE) ELSE c / len(a) END, 6) AS precision, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(a = b AS DOUBLE) ELSE c / len(b) END, 6) AS recall FROM o")
def answer_scores(spark, sf_dir):
    """Exact match, precision and recall of free answers."""
    p, r, _ = metrics.token_scores(F.col("pred"), F.col("gold"))
    return c.pairs(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(F.col("pred"), F.col("gold")).alias("em"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@c.query()
def extractive_answers(spark, sf_dir):
    """A turn's first sentence as the answer, from itself on even turns and from the next turn on odd ones."""
    rows = c.pairs(spark, sf_dir).withColumn("said", F.coalesce(F.get(T.sentences(F.col("pred")), F.lit(0)), F.lit("")))
    source = F.when(F.col("turn") % 2 == 0, F.col("pred")).otherwise(F.col("gold"))
    return rows.select("conv_id", "turn", F.round(metrics.extractiveness(source, F.col("said")), 6).alias("score"))


@c.query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS gold_id FROM labels WHERE quality = 1")
def gold_ids(spark, sf_dir):
    """Documents of good quality stand for the contexts that a task refers to."""
    return c.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", gold_id(F.col("doc_id").cast("string")).alias("gold_id"))


@c.query(f"WITH {c.DOC_BM25}, {c.top_sql('m', 5, 't')} SELECT DISTINCT query_id, substr(sha256(CAST(id AS VARCHAR)), 1, 16) AS gold_id FROM t WHERE rank <= 2")
def reference_ids(spark, sf_dir):
    """Of a task's five contexts the first two are its references."""
    one = F.struct(F.lit(None).cast("string").alias("document_id"), F.col("id").cast("string").alias("id"), (F.col("rank") <= 2).alias("reference"))
    tasks = c.doc_hits(spark, sf_dir, 5).groupBy("query_id").agg(F.collect_list(one).alias("contexts"))
    return relevant_ids(tasks)


@c.query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS decision FROM events")
def decision_extract(spark, sf_dir):
    notes = F.when(F.col("event_id") % 4 == 0, "no judge").otherwise(F.concat(F.lit("round 2; final judge decision="), "event_type", F.lit("; done")))
    return c.read(spark, sf_dir, "events").select("event_id", decision(notes).alias("decision"))


@c.query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS answer FROM nation")
def yes_or_no(spark, sf_dir):
    said = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit(" Yes, "), "n_name")).when(F.col("n_nationkey") % 4 == 1, F.lit("```no code``` NO.")).when(F.col("n_nationkey") % 4 == 2, F.concat("n_name", F.lit(" no"))).otherwise("")
    return c.read(spark, sf_dir, "nation").select("n_nationkey", T.yes_or_no(said).alias("answer"))


@c.query("SELECT n_nationkey, n_name || '|b|' || n_nationkey AS items FROM nation")
def list_items(spark, sf_dir):
    raw = F.concat("n_name", F.lit(" , b;none\n"), F.col("n_nationkey").cast("string"), F.lit(", N/A;  ;b,null"))
    return c.read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(T.items(raw), "|").alias("items"))


@c.query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1")
def conversation_turns(spark, sf_dir):
    rows = conversations(c.read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("transcript"))
