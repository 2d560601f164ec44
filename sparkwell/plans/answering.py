"""Plans around answers: serialised passages, cards, evidence, shaped contexts, controllers and conditioned scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell.functions import text as T
from sparkwell.operators import metrics, variants


def passage(title: Column, text: Column) -> Column:
    """Text as an embedding model of the passage/query kind wants it."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("passage: "), title, F.lit(": "), text)).otherwise(F.concat(F.lit("passage: "), text))


def shaped(hits: DataFrame, include: DataFrame, exclude: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): included documents first, then the hits; excluded ones go; each once, k in all."""
    both = include.select("query_id", "id", F.lit(0).alias("p"), "rank").unionByName(hits.select("query_id", "id", F.lit(1).alias("p"), "rank"))
    kept = both.join(exclude.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min(F.struct("p", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank")


def rule_stop(cov: Column, supportive: Column, novel: Column, overlap: Column, round_: Column) -> Column:
    """Enough coverage by two contexts, or, after the first round, nothing new or hardly an overlap."""
    return ((cov >= 0.6) & (supportive >= 2)) | ((round_ >= 1) & ((novel == 0) | (overlap <= 1)))


def evidence_stop(cov: Column, supportive: Column) -> Column:
    return (cov >= 0.85) | ((cov >= 0.65) & (supportive >= 2))


def needs_correction(cov: Column, supportive: Column) -> Column:
    return F.round(0.7 * cov + 0.3 * F.least(supportive / 2, F.lit(1.0)), 9) < 0.45


def conditioned(score: Column, said_nothing: Column, should_say_nothing: Column) -> Column:
    """1 where both abstain, 0 where one does, else the score."""
    return F.when(said_nothing & should_say_nothing, 1.0).when(said_nothing | should_say_nothing, 0.0).otherwise(score)


def asked(text: Column) -> Column:
    """The query's side of it."""
    return F.concat(F.lit("query: "), text)


@c.query("SELECT item_id, 'query: ' || text AS query FROM benchmark")
def query_serialise(spark, sf_dir):
    return c.read(spark, sf_dir, "benchmark").select("item_id", asked(F.col("text")).alias("query"))


@c.query("SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN 'passage: ' || url || ': ' ELSE 'passage: ' END || html AS passage FROM pages")
def passage_serialise(spark, sf_dir):
    return c.read(spark, sf_dir, "pages").select("page_id", passage(F.col("url"), F.col("html")).alias("passage"))


def any_cue(cues: list[str]) -> str:
    return " OR ".join(f"contains(lower(x), '{w}')" for w in cues)


@c.query(
    f"""WITH s AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS text, {c.SENTENCES.format("coalesce(text, '')")} AS ss FROM documents),
k AS (SELECT doc_id, title, coalesce(list_filter(ss, lambda x: {any_cue(variants.CAUSE_CUES)})[1], ss[1], substr(text, 1, 220)) AS cause, CASE WHEN len(ss) > 0 THEN array_to_string(ss[1:2], ' ') ELSE substr(text, 1, 320) END AS evidence,
coalesce(list_filter(ss, lambda x: {any_cue(variants.RESOLUTION_CUES)})[-1], ss[1], substr(text, 1, 220)) AS resolution,
list_filter(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({", ".join(f"'{w}'" for w in variants.CARD_STOPWORDS)})) AS ws FROM s)
SELECT doc_id, cause, evidence, resolution, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8], ' ') AS terms FROM k"""
)
def knowledge_card(spark, sf_dir):
    """The source stands for the title."""
    return c.read(spark, sf_dir, "documents").select("doc_id", variants.card(F.col("source"), F.col("text")).alias("k")).select("doc_id", "k.cause", "k.evidence", "k.resolution", "k.terms")


@c.query(
    f"""WITH {c.DOC_BM25}, {c.top_sql("m", 20, "t")}, z AS (SELECT query_id, id, 0 AS p, rank FROM t WHERE rank BETWEEN 11 AND 12 UNION ALL SELECT query_id, id, 1, rank FROM t WHERE rank <= 10),
o AS (SELECT query_id, id, min((p, rank)) AS pl FROM z ANTI JOIN (SELECT query_id AS q, id AS i FROM t WHERE rank = 1) x ON q = query_id AND i = id GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pl, id) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pl, id) <= 5"""
)
def context_shaping(spark, sf_dir):
    """Hits 11 and 12 are asked for, the first is refused."""
    hits = c.doc_hits(spark, sf_dir)
    return shaped(hits.where("rank <= 10"), hits.where("rank between 11 and 12"), hits.where("rank = 1"), 5)


STATES = "x AS (SELECT event_id, (event_id % 11) / 10 AS cov, event_id % 4 AS sup, event_id % 3 AS nov, event_id % 5 AS ov, event_id % 2 AS rnd FROM events)"


@c.query(
    f"""WITH {STATES} SELECT event_id, (cov >= 0.6 AND sup >= 2) OR (rnd >= 1 AND (nov = 0 OR ov <= 1)) AS rule_stop,
cov >= 0.85 OR (cov >= 0.65 AND sup >= 2) AS evidence_stop, round(0.7 * cov + 0.3 * least(sup / 2, 1.0), 9) < 0.45 AS correct FROM x"""
)
def rule_controllers(spark, sf_dir):
    e = F.col("event_id")
    x = c.read(spark, sf_dir, "events").select("event_id", ((e % 11) / 10).alias("cov"), (e % 4).alias("sup"), (e % 3).alias("nov"), (e % 5).alias("ov"), (e % 2).alias("rnd"))
    cov, sup, nov, ov, rnd = (F.col(k) for k in ("cov", "sup", "nov", "ov", "rnd"))
    return x.select("event_id", rule_stop(cov, sup, nov, ov, rnd).alias("rule_stop"), evidence_stop(cov, sup).alias("evidence_stop"), needs_correction(cov, sup).alias("correct"))


def abstains_sql(tokens: str) -> str:
    return f"(len({tokens}) = 0 OR " + " OR ".join(f"contains(array_to_string({tokens}, ' '), '{m}')" for m in T.ABSTENTIONS) + ")"


@c.query(
    f"""WITH {c.F1}, s AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * c / (len(a) + len(b)) END AS f1, {abstains_sql("a")} AS x, {abstains_sql("b")} OR turn % 5 = 0 AS y FROM o)
SELECT conv_id, turn, round(CASE WHEN x AND y THEN 1.0 WHEN x OR y THEN 0.0 ELSE f1 END, 6) AS f1, x = y AS agree FROM s"""
)
def conditioned_scores(spark, sf_dir):
    """No answer is expected where the gold one abstains, and at every fifth turn."""
    said, should = T.abstains(F.col("pred")), T.abstains(F.col("gold")) | (F.col("turn") % 5 == 0)
    f1 = metrics.token_scores(F.col("pred"), F.col("gold"))[2]
    return c.pairs(spark, sf_dir).select("conv_id", "turn", F.round(conditioned(f1, said, should), 6).alias("f1"), (said == should).alias("agree"))
