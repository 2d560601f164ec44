"""Column expressions over text: cleaning, splitting, tokens and answer normalisation.  Nulls give nulls or empty arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that query terms leave out, and the phrases of a normalised answer that mark an abstention.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "what",
    "when", "which", "who", "with",
]
ABSTENTIONS = [
    "i dont know", "i do not know", "i dont have", "i do not have", "dont have the answer", "do not have the answer",
    "dont have enough information", "do not have enough information", "not enough information", "cannot answer", "cant answer",
    "cannot determine", "unable to answer", "document does not provide", "documents do not provide", "context does not provide",
    "i am sorry but", "im sorry but", "sorry but i",
]


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def html_title(html: Column, fallback: Column) -> Column:
    return first_filled(squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), fallback)


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles go without a trace, tags become spaces, white space is squeezed; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of stripped windows, one each size - overlap characters while they start inside the text; blank ones go."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    # one scan of the text: each match takes a step and looks ahead over a window
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct ASCII terms of three characters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS)))


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")


def answer_tokens(text: Column) -> Column:
    """Tokens of an answer: lower case, punctuation gone, then articles gone."""
    words = F.split(F.regexp_replace(drop_punctuation(F.lower(text)), r"\s+", " "), " ")
    return F.filter(words, lambda w: ~w.isin("", "a", "an", "the"))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def normalize_articles_first(text: Column) -> Column:
    """The other order: articles go as words, and then punctuation."""
    bare = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return squeeze(drop_punctuation(bare))


def scored_tokens(text: Column) -> Column:
    """Tokens of the other order, by which free answers are scored."""
    return F.filter(F.split(normalize_articles_first(text), " "), lambda w: w != "")


def abstains(text: Column) -> Column:
    """True for an answer of which normalising leaves nothing, or one with a phrase of ABSTENTIONS; null counts as nothing."""
    bare = F.coalesce(normalize_articles_first(text), F.lit(""))
    return (bare == "") | reduce(lambda a, b: a | b, (bare.contains(m) for m in ABSTENTIONS))


def unfenced(text: Column) -> Column:
    """Text without what stands between code fences."""
    return F.regexp_replace(text, "```[^`]*```", "")


def number_in(text: Column) -> Column:
    """The first number of an answer without code, thousands' commas, $ and %; null if there is none."""
    return F.regexp_extract(F.regexp_replace(unfenced(text), "[,$%]", ""), r"-?\d+\.?\d*", 0).try_cast("double")


def yes_or_no(text: Column) -> Column:
    """yes or no where that is an answer's first word, else null."""
    word = F.regexp_replace(F.get(F.split(squeeze(unfenced(F.lower(text))), " "), F.lit(0)), "[.,!;:]+$", "")
    return F.when(word.isin("yes", "no"), word)


def items(raw: Column) -> Column:
    """The distinct entries of a list in one text, cut at commas, semicolons and line ends; none, null and n/a go."""
    parts = F.transform(F.split(raw, "[,;\\n]"), strip)
    return F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin("", "none", "null", "n/a")))


def close(a: Column, b: Column, rel: float = 1e-3, least: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def numbers_match(predicted: Column, gold: Column) -> Column:
    """Equal within tolerance, or so after a factor of 100 either way where the smaller side is under 10."""
    return F.coalesce(close(predicted, gold) | ((F.abs(gold) < 10) & close(predicted, gold * 100)) | ((F.abs(predicted) < 10) & close(predicted * 100, gold)), F.lit(False))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, by one fold over both in order: a's copies of a value wait for b's."""
    side = lambda arr, n: F.transform(arr, lambda x: F.struct(x.alias("w"), F.lit(n).alias("s")))
    first = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(acc, e):
        left = F.when(acc["w"].eqNullSafe(e["w"]), acc["left"]).otherwise(0)
        return F.struct(e["w"].alias("w"), F.when(e["s"] == 0, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"), (acc["n"] + F.when((e["s"] == 1) & (left > 0), 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), first, step, lambda x: x["n"])
