"""Fusing ranked lists, and reordering what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions.text import query_terms, sentences, squeeze, strip
from sparkwell.operators.embedding import best_sentence

RRF_K = 60


def rrf(lists: list[tuple[DataFrame, float | str]], k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf, rank): weighted reciprocal-rank fusion of (query_id, id, rank, score) lists.

    A weight is a number, or names a column of its list, so that it may differ from query to query.  An id that a list has
    several times counts there once, at its best rank.

    Equal sums go by the raw score of the hit in the first list that has it, then by first appearance.
    """
    out = None
    for n, (df, weight) in enumerate(lists):
        part = df.select("query_id", "id", F.lit(n).alias("list"), "rank", "score", ((F.col(weight) if isinstance(weight, str) else F.lit(float(weight))) / (constant + F.col("rank"))).alias("w"))
        out = part if out is None else out.unionByName(part)
    once = out.groupBy("query_id", "id", "list").agg(F.min(F.struct("rank", "score", "w")).alias("b")).select("query_id", "id", "list", "b.*")
    fused = once.groupBy("query_id", "id").agg(F.sum("w").alias("rrf"), F.min(F.struct("list", "rank", "score")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.round("first.score", 9).desc(), "first.list", "first.rank", "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rrf", "rank")


def list_weights(query: Column) -> tuple[Column, Column]:
    """(dense, lexical) weights: 1:3 with digits, quotes or acronyms, 2:1 for six words or fewer, else 1:1.

    An acronym's edges are those of ASCII words, so that a letter beyond ASCII ends it.
    """
    exact = query.rlike("[0-9\"']") | query.rlike(r"(?<![A-Za-z0-9_])[A-Z]{2,}(?![A-Za-z0-9_])")
    short = F.size(F.split(squeeze(query), " ")) <= 6
    return F.when(exact, 1.0).when(short, 2.0).otherwise(1.0), F.when(exact, 3.0).otherwise(1.0)


def anchors_first(anchors: DataFrame, fused: DataFrame, k: int, first: int = 2) -> DataFrame:
    """(query_id, id, rank): the best `first` of anchors, then the fused list, each id once, k in all."""
    both = anchors.where(F.col("rank") <= first).select("query_id", "id", F.lit(0).alias("p"), "rank").unionByName(fused.select("query_id", "id", F.lit(1).alias("p"), "rank"))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("p", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank")


def compact_contexts(rows: DataFrame, order: str = "rank") -> DataFrame:
    """rows (query_id, title, text): of each query's contexts with the same text, up to case and white space, the first; texts lose a leading title."""
    nth = F.row_number().over(Window.partitionBy("query_id", F.sha2(F.lower(squeeze(F.col("text"))), 256)).orderBy(order))
    text = strip(F.col("text"))
    bare = F.regexp_replace(F.substr(text, F.length("title") + 1), r"^[ :\n\-]+", "")
    titled = (F.coalesce("title", F.lit("")) != "") & F.startswith(text, F.col("title"))
    return rows.withColumn("__n", nth).where("__n = 1").drop("__n").withColumn("text", F.when(titled, bare).otherwise(text))


def sentence_rerank(hits: DataFrame, per: int = 6) -> DataFrame:
    """hits (query_id, query, id, text, score) with best and rank: by the best of a context's first sentences.

    A sentence scores the share of the query's terms that it has; a context without sentences scores -1; then the
    retrieval score decides, then the id.
    """
    rows = hits.withColumn("__terms", query_terms(F.col("query")))
    terms = F.col("__terms")
    share = lambda s: F.size(F.filter(terms, lambda t: F.lower(s).contains(t))) / F.greatest(F.size(terms), F.lit(1))
    best = F.coalesce(F.array_max(F.transform(F.slice(sentences(F.col("text")), 1, per), share)), F.lit(-1.0))
    order = Window.partitionBy("query_id").orderBy(F.round("best", 9).desc(), F.round("score", 9).desc(), "id")
    return rows.withColumn("best", best).withColumn("rank", F.row_number().over(order)).drop("__terms")


def snippets(hits: DataFrame, most: int = 2) -> DataFrame:
    """hits with snippet (the best `most` sentences by matched terms, in that order) and gain added to score."""
    rows = hits.withColumn("__terms", query_terms(F.col("query")))
    terms = F.col("__terms")
    weight = lambda s: F.aggregate(F.filter(terms, lambda t: F.lower(s).contains(t)), F.lit(0), lambda a, t: a + F.greatest(F.length(t), F.lit(3)))
    scored = F.transform(sentences(F.col("text")), lambda s, i: F.struct((-weight(s)).alias("w"), i.alias("i"), s.alias("s")))
    top = F.slice(F.array_sort(F.filter(scored, lambda x: x["w"] < 0)), 1, most)
    out = rows.withColumn("__top", top)
    gain = F.aggregate("__top", F.lit(0), lambda a, x: a - x["w"])
    return out.withColumn("snippet", F.array_join(F.transform("__top", lambda x: x["s"]), " ")).withColumn("score", F.col("score") + gain).drop("__terms", "__top")


def semantic_rerank(hits: DataFrame, per: int = 6) -> DataFrame:
    """hits (query_id, query, id, text, score) with best and rank: by the largest cosine of the query with a context's first sentences.

    A context without sentences scores -1; then the retrieval score decides, then the id.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("best", 9).desc(), F.round("score", 9).desc(), "id")
    return hits.withColumn("best", F.coalesce(best_sentence(F.col("query"), F.col("text"), per), F.lit(-1.0))).withColumn("rank", F.row_number().over(order))


def first_filled_list(lists: list[DataFrame]) -> DataFrame:
    """Of lists (query_id, id, rank, score) each query's hits from the first that has any for it."""
    out = None
    for n, df in enumerate(lists):
        part = df.select("query_id", "id", "rank", "score", F.lit(n).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("__l", F.min("list").over(Window.partitionBy("query_id"))).where("list = __l").drop("__l")


def capped(rows: DataFrame, k: int, per: int = 2) -> DataFrame:
    """rows (query_id, title, overlap, score, size, id) with place: by overlap, score and then brevity, at most `per` of a title, k in all.

    A query of k rows or fewer keeps them all.
    """
    order = [F.desc("overlap"), F.round("score", 9).desc(), "size", "id"]
    own = Window.partitionBy("query_id")
    out = rows.withColumn("__n", F.count("*").over(own)).withColumn("__t", F.row_number().over(Window.partitionBy("query_id", "title").orderBy(*order)))
    out = out.where((F.col("__n") <= k) | (F.col("__t") <= per)).withColumn("place", F.row_number().over(own.orderBy(*order)))
    return out.where(F.col("place") <= k).drop("__n", "__t")


def debated(votes: DataFrame) -> DataFrame:
    """votes (query_id, id, support, challenge, verdict) with score and place: twice the support less the challenge, and what the verdict adds."""
    # What a verdict adds.
    bonus = F.when(F.col("verdict") == "keep", 1.5).when(F.col("verdict") == "borderline", 0.5).when(F.col("verdict") == "drop", -1.0).otherwise(0.0)
    rows = votes.withColumn("score", 2.0 * F.col("support") - F.col("challenge") + bonus)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
