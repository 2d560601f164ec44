"""Numeric retrieval policies: coverage traces, stopping, dispersion gates, routing and verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions.text import squeeze


def coverage(terms: Column, text: Column) -> Column:
    """Share of the terms that the text has as substrings."""
    hit = F.size(F.filter(terms, lambda t: F.lower(text).contains(t)))
    return F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(0.0)


def trace(batches: DataFrame) -> DataFrame:
    """(query_id, round, coverage, supportive, novelty, gain) of batches (query_id, round, id, terms, text), and title where there is one.

    Coverage is of all contexts up to the round; a context with two terms or more is supportive; novelty is the share
    of the round's contexts that no earlier round had (1 in the first); gain is how much coverage rose.
    """
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))) if "title" in batches.columns else F.col("text")
    matched = F.filter("terms", lambda t: F.lower(hay).contains(t))
    rows = batches.select("query_id", "round", "id", "terms", matched.alias("m"))
    first = rows.groupBy("query_id", "id").agg(F.min("round").alias("first"))
    rows = rows.join(first, ["query_id", "id"])
    per = rows.groupBy("query_id", "round").agg(F.first("terms").alias("terms"), F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"), F.count_if(F.col("first") == F.col("round")).alias("new"), F.count("*").alias("n"), F.count_if((F.size("m") >= 2) & (F.col("first") == F.col("round"))).alias("s"))
    upto = Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("m").over(upto))))
    out = per.select("query_id", "round", F.when(F.size("terms") > 0, seen / F.size("terms")).otherwise(0.0).alias("coverage"), F.sum("s").over(upto).alias("supportive"), (F.col("new") / F.col("n")).alias("novelty"))
    before = F.lag("coverage").over(Window.partitionBy("query_id").orderBy("round"))
    return out.withColumn("gain", F.greatest(F.col("coverage") - F.coalesce(before, F.lit(0.0)), F.lit(0.0)))


def should_stop(cov: Column, supportive: Column, novelty: Column, gain: Column, round_: Column, bonus: Column | float = 0.0, digits: int | None = None) -> Column:
    """True where stopping scores at least as high as going on, to so many digits if given, and always from the third round on."""
    go = 0.55 * (1 - cov) + 0.25 * gain + 0.20 * novelty + bonus - 0.15 * round_
    stop = 0.60 * cov + 0.20 * F.least(supportive / 2, F.lit(1.0)) + F.when(round_ > 0, 0.20 * (1 - novelty)).otherwise(0.0)
    if digits is not None:
        stop, go = F.round(stop, digits), F.round(go, digits)
    return (round_ >= 2) | (stop >= go)


def dispersion(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, qpp, nqc): population deviation of the best positive scores over the largest, and over the mean."""
    top = hits.where((F.col("score") > 0) & (F.col("rank") <= most))
    out = top.groupBy("query_id").agg(F.stddev_pop("score").alias("sd"), F.max("score").alias("top"), F.avg("score").alias("mean"))
    return out.select("query_id", (F.col("sd") / F.col("top")).alias("qpp"), (F.col("sd") / F.abs("mean")).alias("nqc"))


def pair_ratio(own: DataFrame, ends: int = 3, least: int = 4) -> DataFrame:
    """(query_id, ratio) of own (query_id, id, query, embedding), a query's few hits: mean weight of the heaviest `ends` pairs over that of the lightest.

    A pair weighs its similarity times those of both hits to the query, none of them below 0.  Null for fewer than
    `least` hits and where all weights are 0; infinite where only the lightest are.  Null or zero vectors are similar to nothing.
    """
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, z: s + z)
    similar = lambda p, q: F.coalesce(F.greatest(F.try_divide(dot(p, q), F.sqrt(dot(p, p) * dot(q, q))), F.lit(0.0)), F.lit(0.0))
    rows = own.select("query_id", "id", "embedding", similar(F.col("query"), F.col("embedding")).alias("s"))
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    a = rows.select("query_id", F.col("id").alias("a"), F.col("embedding").alias("x"), F.col("s").alias("sa"))
    b = rows.select("query_id", F.col("id").alias("b"), F.col("embedding").alias("y"), F.col("s").alias("sb"))
    weight = similar(F.col("x"), F.col("y")) * F.col("sa") * F.col("sb")
    pairs = a.join(b, "query_id").where("a < b").groupBy("query_id").agg(F.sort_array(F.collect_list(weight), asc=False).alias("w"))  # k hits to a query
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size(w)
    head, tail = mean(F.slice("w", 1, ends)), mean(F.slice("w", -F.least(F.size("w"), F.lit(ends)), F.least(F.size("w"), F.lit(ends))))
    ratio = F.when(F.col("n") < least, None).when(tail > 0, F.try_divide(head, tail)).when(head > 0, F.lit(float("inf")))
    return n.join(pairs, "query_id", "left").select("query_id", ratio.alias("ratio"))


# Parts of a query that ask for the rich route.
RICH_CUES = ("both", "compare", "which other", "same", "different", "before", "after", "ratio")


def rich_route(query: Column, cues: tuple[str, ...] = RICH_CUES) -> Column:
    """True for queries of twelve words or more, or with a cue in them: they are rewritten and get the larger pool."""
    out = F.size(F.split(squeeze(query), " ")) >= 12
    for cue in cues:
        out = out | F.lower(query).contains(cue)
    return out


def verdict(votes: DataFrame) -> DataFrame:
    """(query_id, verdict) of votes (query_id, vote): SUPPORTED, CONTRADICTED, MIXED or INSUFFICIENT."""
    out = votes.groupBy("query_id").agg(F.count_if(F.col("vote") == "SUPPORTED").alias("s"), F.count_if(F.col("vote") == "CONTRADICTED").alias("c"))
    name = F.when((F.col("s") > 0) & (F.col("c") > 0), "MIXED").when(F.col("s") > 0, "SUPPORTED").when(F.col("c") > 0, "CONTRADICTED").otherwise("INSUFFICIENT")
    return out.select("query_id", name.alias("verdict"))


def list_route(dense: Column, lexical: Column, least: float = 0.10) -> Column:
    """Which lists to use by their dispersions: fuse, vector, text or retry."""
    return F.when((dense >= least) & (lexical >= least), "fuse").when(dense >= least, "vector").when(lexical >= least, "text").otherwise("retry")
