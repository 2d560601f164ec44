"""Scores of answers, evidence and rankings; cost by a price list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell import ship
from sparkwell.functions.text import answer_tokens, let, multiset_overlap, normalize_articles_first, scored_tokens

ship(__name__)

# Dollars for a million tokens of input, cached input and output, by model; and for models not listed.
PRICES = [
    ("gpt-5.4", 2.50, 0.25, 15.00),
    ("gpt-5.2", 1.75, 0.175, 14.00),
    ("gpt-5.1", 1.25, 0.125, 10.00),
    ("gpt-5", 1.25, 0.125, 10.00),
    ("gpt-5-mini", 0.25, 0.025, 2.00),
    ("gpt-5-nano", 0.05, 0.005, 0.40),
    ("gpt-4.1", 3.50, 0.875, 14.00),
    ("gpt-4.1-mini", 0.70, 0.175, 2.80),
    ("gpt-4.1-nano", 0.20, 0.05, 0.80),
    ("gpt-4o", 2.50, 1.25, 10.00),
    ("gpt-4o-mini", 0.15, 0.075, 0.60),
    ("o3-mini", 1.10, 0.55, 4.40),
    ("claude-opus-4-6", 5.00, 0.50, 25.00),
    ("claude-sonnet-4-6", 3.00, 0.30, 15.00),
    ("claude-opus-4-5", 5.00, 0.50, 25.00),
    ("claude-sonnet-4-5", 3.00, 0.30, 15.00),
    ("claude-haiku-4-5", 1.00, 0.10, 5.00),
    ("claude-opus-4-1", 15.00, 1.50, 75.00),
    ("claude-opus-4", 15.00, 1.50, 75.00),
    ("claude-sonnet-4", 3.00, 0.30, 15.00),
]
DEFAULT_PRICE = (0.25, 0.025, 2.00)


def price_table(spark: SparkSession, prices: list[tuple] = PRICES) -> DataFrame:
    return spark.createDataFrame(prices, "prefix string, p_in double, p_cached double, p_out double")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def token_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of tokens; both empty score 1, one empty 0.  Each text is cut into tokens once for all three."""

    def of(t):
        n, m, common = t["n"], t["m"], t["common"]
        empty = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
        return F.struct(empty.otherwise(common / n).alias("p"), empty.otherwise(common / m).alias("r"), empty.otherwise(ratio(2.0 * common, (n + m).cast("double"))).alias("f"))

    scores = let(F.struct(scored_tokens(predicted).alias("a"), scored_tokens(gold).alias("b")), lambda t: let(F.struct(F.size(t["a"]).alias("n"), F.size(t["b"]).alias("m"), multiset_overlap(t["a"], t["b"]).alias("common")), of))
    return scores["p"], scores["r"], scores["f"]


def strict_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column, Column]:
    """(EM, precision, recall, F1) of short answers: all but EM 0 where one side is yes, no or noanswer and the other isn't the same, or nothing is shared."""

    def of(t):
        p, g, n, m, common = t["p"], t["g"], t["n"], t["m"], t["common"]
        closed = p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")
        none = F.when(closed & (p != g), 0.0).when(common == 0, 0.0)
        return F.struct((p == g).cast("double").alias("em"), none.otherwise(common / n).alias("p"), none.otherwise(common / m).alias("r"), none.otherwise(2.0 * common / (n + m)).alias("f"))

    sides = lambda t: F.struct(F.array_join(t["a"], " ").alias("p"), F.array_join(t["b"], " ").alias("g"), F.size(t["a"]).alias("n"), F.size(t["b"]).alias("m"), multiset_overlap(t["a"], t["b"]).alias("common"))
    scores = let(F.struct(answer_tokens(predicted).alias("a"), answer_tokens(gold).alias("b")), lambda t: let(sides(t), of))
    return scores["em"], scores["p"], scores["r"], scores["f"]


def strict_f1(predicted: Column, gold: Column) -> Column:
    return strict_scores(predicted, gold)[3]


def exact_match(predicted: Column, gold: Column) -> Column:
    """1 where free answers are the same once normalised, else 0."""
    return (normalize_articles_first(predicted) == normalize_articles_first(gold)).cast("double")


def extractiveness(source: Column, predicted: Column) -> Column:
    """1 where the source holds the answer, both normalised, else ROUGE-L; with one empty, 1 if both are."""
    s, p = normalize_articles_first(source), normalize_articles_first(predicted)
    return F.when((s == "") | (p == ""), (s == p).cast("double")).when(F.contains(s, p), 1.0).otherwise(rouge_l(source, predicted))


def fact_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column, Column]:
    """(precision, recall, F1, EM) of two sets as arrays; both empty: EM 1 and the rest 0."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g))
    pr, rc = ratio(hit.cast("double"), F.size(p)), ratio(hit.cast("double"), F.size(g))
    em = ((hit == F.size(p)) & (hit == F.size(g))).cast("double")
    return pr, rc, ratio(2 * pr * rc, pr + rc), em


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a table row as the bits of one integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, over Arrow batches; null where one is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else common_length(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def rouge_l(predicted: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of tokens; both empty score 1."""
    p, g = scored_tokens(predicted), scored_tokens(gold)
    n, m = F.size(p), F.size(g)
    lcs = lcs_length(p, g)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * lcs / (n + m))


def ranking_scores(hits: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, recall_k, ndcg_k for each cutoff) for every query of gold (query_id, id); hits (query_id, id, rank).

    Ids count once, at their best rank; gain is binary; discount is log2(rank + 1).  A query without hits scores 0.
    """
    right = gold.select("query_id", "id").distinct()
    n = right.groupBy("query_id").agg(F.count("*").alias("n"))
    return scores_of_ranks(unique_ranks(hits, max(cutoffs)).join(right, ["query_id", "id"]), n, cutoffs)


def unique_ranks(hits: DataFrame, most: int) -> DataFrame:
    """(query_id, id, rank) up to `most`: each id once, at its best rank, renumbered."""
    once = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def scores_of_ranks(found: DataFrame, n: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The same from the relevant hits found (query_id, rank) and how many a query has, n (query_id, n): no list of all relevant ids is needed."""
    sums = found.groupBy("query_id").agg(*(F.sum(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"h{k}") for k in cutoffs), *(F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in cutoffs))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    out = n.join(sums, "query_id", "left")
    return out.select("query_id", *(F.coalesce(F.col(f"h{k}") / F.col("n"), F.lit(0.0)).alias(f"recall_{k}") for k in cutoffs), *(F.coalesce(F.col(f"d{k}") / ideal(k), F.lit(0.0)).alias(f"ndcg_{k}") for k in cutoffs))


def priced(usage: DataFrame, prices: DataFrame, default: tuple[float, float, float] = DEFAULT_PRICE) -> DataFrame:
    """usage (model, n_in, n_cached, n_out) with cost in dollars: prices of the longest listed prefix of the model, else default.

    prices (prefix, p_in, p_cached, p_out), in dollars for a million tokens, is a small list.
    """
    models = usage.select("model").distinct()
    match = models.join(F.broadcast(prices), F.col("model").startswith(F.col("prefix")))
    best = match.groupBy("model").agg(F.max(F.struct(F.length("prefix").alias("l"), "p_in", "p_cached", "p_out")).alias("b"))
    rows = usage.join(best, "model", "left")
    price = {c: F.coalesce(F.col(f"b.{c}"), F.lit(d)) for c, d in zip(("p_in", "p_cached", "p_out"), default)}
    cost = ((F.col("n_in") - F.col("n_cached")) * price["p_in"] + F.col("n_cached") * price["p_cached"] + F.col("n_out") * price["p_out"]) / 1e6
    return rows.withColumn("cost", cost).drop("b")
