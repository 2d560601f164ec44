"""Other ways to cut documents up: greedy packing of units, trees of summaries, pages, cards, labels and triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.text import let, sentences, squeeze, strip, windows


def packed(units: Column, size: int = 512, glue: str = " ") -> Column:
    """Units greedily joined into chunks of at most `size` characters; a longer unit is a chunk of its own."""

    def add(acc, u):
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.length(last) + len(glue) + F.length(u) <= size
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(glue), u)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(u)))

    return F.aggregate(units, F.array().cast("array<string>"), add)


def structure_units(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Paragraphs, lines of long paragraphs, sentences of long lines, and windows of long sentences."""
    sized = lambda parts, finer: F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(finer(p))))
    filled = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    lines = lambda p: sized(filled(F.split(p, r"\n")), lambda x: sized(sentences(x), lambda s: windows(s, size, overlap)))
    return sized(filled(F.split(text, r"\n\s*\n")), lines)


def structure_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_index, chunk) along paragraphs, lines and sentences."""
    return docs.select("doc_id", F.posexplode(packed(structure_units(F.col("text"), size, overlap), size)).alias("chunk_index", "chunk"))


def summary_tree(chunks: DataFrame, fan: int = 4) -> DataFrame:
    """(doc_id, node, n_children, summary): for every `fan` chunks the first sentence of each, joined."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    rows = chunks.withColumn("node", F.floor(F.col("chunk_index") / fan)).groupBy("doc_id", "node").agg(parts.alias("p"))
    firsts = F.filter(F.transform("p", lambda x: F.get(sentences(x["chunk"]), F.lit(0))), lambda s: s.isNotNull())
    return rows.select("doc_id", "node", F.size("p").alias("n_children"), F.array_join(firsts, " ").alias("summary"))


def tree_records(chunks: DataFrame, fan: int = 4) -> DataFrame:
    """(doc_id, record_type, node, text, hash_id, parent_id, child_hash_ids, n_children) of hashed chunks: a summary for every `fan` places, and the chunks as its leaves.

    A summary is the first sentence of each chunk; its identity is its document's, its node's and its text's.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk", "hash_id")))
    rows = chunks.withColumn("node", F.floor(F.col("chunk_index") / fan)).groupBy("doc_id", "node").agg(parts.alias("p"))
    firsts = F.filter(F.transform("p", lambda x: F.get(sentences(x["chunk"]), F.lit(0))), lambda s: s.isNotNull())
    nodes = rows.withColumn("summary", F.array_join(firsts, " "))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.lit(":node:"), F.col("node").cast("string"), F.lit("\n"), squeeze(F.col("summary")))
    nodes = nodes.withColumn("own", F.sha2(F.encode(key, "UTF-8"), 256))
    none = F.lit(None).cast("string")
    top = F.struct(F.lit("summary").alias("record_type"), F.col("summary").alias("text"), F.col("own").alias("hash_id"), none.alias("parent_id"), F.transform("p", lambda x: x["hash_id"]).alias("child_hash_ids"), F.size("p").alias("n_children"))
    leaf = lambda x: F.struct(F.lit("leaf").alias("record_type"), x["chunk"].alias("text"), x["hash_id"].alias("hash_id"), F.col("own").alias("parent_id"), F.array().cast("array<string>").alias("child_hash_ids"), F.lit(0).alias("n_children"))
    return nodes.select("doc_id", "node", F.explode(F.concat(F.array(top), F.transform("p", leaf))).alias("r")).select("doc_id", "node", "r.*")


def pages(chunks: DataFrame, fan: int = 4, per: int = 4, most: int = 800) -> DataFrame:
    """(doc_id, page_number, page): of every `fan` chunks the first `per` sentences, at most `most` characters."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    rows = chunks.withColumn("page_number", (F.floor(F.col("chunk_index") / fan) + 1)).groupBy("doc_id", "page_number").agg(parts.alias("p"))
    text = F.array_join(F.slice(F.flatten(F.transform("p", lambda x: sentences(x["chunk"]))), 1, per), " ")
    return rows.select("doc_id", "page_number", F.substring(text, 1, most).alias("page")).where("page <> ''")


def triples(docs: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, n, subject, relation, object): words 1-2, 3 and 4-7 of parts between ". " of five words or more."""
    words = F.filter(F.transform(F.split("text", r"\. "), lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")), lambda w: F.size(w) >= 5)
    rows = docs.select("doc_id", F.posexplode(F.slice(words, 1, most)).alias("n", "w"))
    return rows.select("doc_id", "n", F.array_join(F.slice("w", 1, 2), " ").alias("subject"), F.get("w", F.lit(2)).alias("relation"), F.array_join(F.slice("w", 4, 4), " ").alias("object"))


# Labels, and the words one of which a text must have for it; a year gives the first of all labels.
DATED = "temporal/date"
LABELS = [
    ("entity/person/biography", ["born", "died", "married", "actor", "writer", "president"]),
    ("entity/location/geography", ["city", "country", "river", "province", "located"]),
    ("entity/work/media", ["film", "album", "song", "novel", "band"]),
    ("event/politics/history", ["battle", "war", "election", "government", "minister"]),
    ("domain/finance/organization", ["company", "bank", "stock", "market", "revenue"]),
]
GENERAL = "general/fact/entity"


def has_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text, inside others too."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def taxonomy(title: Column, text: Column) -> Column:
    """Labels that title and text together give, joined by " > "; words count inside others."""

    def of(low):
        # what stands before is looked at behind four digits alone, not at every place
        dated = F.when(low.rlike(r"\d{4}(?<![\p{L}\p{N}_]\d{4})(?![\p{L}\p{N}_])"), F.lit(DATED))
        return F.array_compact(F.array(dated, *(F.when(has_any(low, words), F.lit(name)) for name, words in LABELS)))

    found = let(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))), of)
    return let(found, lambda x: F.when(F.size(x) > 0, F.array_join(x, " > ")).otherwise(GENERAL))


# Parts of a sentence that tell a cause or an outcome, and words that salient terms leave out.
CAUSE_CUES = ["because", "due to", "after", "from", "caused"]
RESOLUTION_CUES = ["won", "became", "result", "led", "served", "located", "married", "born"]
CARD_STOPWORDS = ["the", "and", "for", "with", "that", "from", "this", "was", "are", "into"]


def card(title: Column, text: Column) -> Column:
    """(cause, evidence, resolution, terms) of a knowledge card: the first sentence with a cue for a cause, the first two
    sentences, the last with a cue for an outcome, and the first eight distinct ASCII terms of four characters or more.

    Where no sentence has a cue the first sentence stands in, and for a text without sentences its first 220 characters
    (320 as evidence); null counts as empty.  It is one struct, so that a text is cut into sentences once for all of them.
    """
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(F.concat(title, F.lit(" "), text)), F.lit("[a-z0-9]{4,}"), F.lit(0))
    terms = F.slice(F.filter(F.array_distinct(words), lambda w: ~w.isin(CARD_STOPWORDS)), 1, 8)

    def of(ss):
        lead = F.coalesce(F.get(ss, F.lit(0)), F.substring(text, 1, 220))
        with_cue = lambda cues: F.filter(ss, lambda s: let(F.lower(s), lambda low: has_any(low, cues)))
        cause = F.coalesce(F.get(with_cue(CAUSE_CUES), F.lit(0)), lead)
        outcome = F.coalesce(F.try_element_at(with_cue(RESOLUTION_CUES), F.lit(-1)), lead)
        evidence = F.when(F.size(ss) > 0, F.array_join(F.slice(ss, 1, 2), " ")).otherwise(F.substring(text, 1, 320))
        return F.struct(cause.alias("cause"), evidence.alias("evidence"), outcome.alias("resolution"), F.array_join(terms, " ").alias("terms"))

    return let(sentences(text), of)


def card_text(title: Column, cause: Column, evidence: Column, resolution: Column, terms: Column) -> Column:
    # The lines' names.
    parts = (("KNOWLEDGE_CARD\nTITLE: ", title), ("\nPROBLEM: ", title), ("\nCAUSE: ", cause), ("\nEVIDENCE: ", evidence), ("\nRESOLUTION: ", resolution), ("\nCARD_TERMS: ", terms))
    return F.concat(*(x for name, c in parts for x in (F.lit(name), c)))
