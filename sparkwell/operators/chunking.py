"""Chunks along a text's structure: packed units, serialised sentence groups, linked records, request batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell import ship
from sparkwell.functions.text import sentences, squeeze, strip, windows
from sparkwell.operators import ingest

ship(__name__)

# The lines of a serialised group, how many sentences it has, and what one sentence may have of the size.
HEAD, LINE, GROUP, SHARE = "TITLE: {}\nPARAGRAPH_STRUCTURE:", "\nSENTENCE_{}: {}", 4, 2
#: Rows that are Python's strings at a time.
ROWS = 64


def groups(units: Column, size: int = 512, glue: int = 1) -> Column:
    """Units (t, alone) in groups whose texts fit `size` characters with `glue` between two; one that is to stand alone does."""
    kind = "struct<done:array<array<string>>,cur:array<string>,n:int>"
    none = F.array().cast("array<string>")
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    def add(acc, u):
        flushed = F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        n = F.length(u["t"])
        fits = (F.size(acc["cur"]) > 0) & (acc["n"] + glue + n <= size)
        own = F.array(u["t"])
        alone = state(F.concat(flushed, F.array(own)), none, F.lit(0))
        return F.when(u["alone"], alone).when(fits, state(acc["done"], F.concat(acc["cur"], own), acc["n"] + glue + n)).otherwise(state(flushed, own, n))

    first = state(F.array().cast("array<array<string>>"), none, F.lit(0)).cast(kind)
    return F.aggregate(units, first, add, lambda x: F.when(F.size(x["cur"]) > 0, F.concat(x["done"], F.array(x["cur"]))).otherwise(x["done"]))


def sized(parts: Column, size: int, overlap: int) -> Column:
    """Parts as units; the windows of a longer part stand alone."""
    whole = lambda p: F.array(F.struct(p.alias("t"), F.lit(False).alias("alone")))
    cut = lambda p: F.transform(windows(p, size, overlap), lambda w: F.struct(w.alias("t"), F.lit(True).alias("alone")))
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, whole(p)).otherwise(cut(p))))


def structural_units(text: Column) -> Column:
    """Lines of paragraphs that have several, and the other paragraphs."""
    filled = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.flatten(F.transform(filled(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{2,}")), lambda p: filled(F.split(p, r"[\n\r]"))))


def unit_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Structural units packed into chunks, a line each."""
    return F.transform(groups(sized(structural_units(text), size, overlap), size), lambda g: F.array_join(g, "\n"))


def sentence_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """(text, sentence_texts) of chunks that are whole sentences; windows of a longer sentence stand alone."""
    parts = F.flatten(F.transform(structural_units(text), sentences))
    return F.transform(groups(sized(parts, size, overlap), size), lambda g: F.struct(F.array_join(g, " ").alias("text"), g.alias("sentence_texts")))


def serialised(title: str, ss: list[str], size: int = 512) -> list[str]:
    """Groups of up to four sentences under their title, numbered through; a group that is too long ends before the sentence that
    doesn't fit (the first is always in), and its sentences are cut to half the size."""
    out, at, head = [], 0, HEAD.format(title)
    while at < len(ss):
        lines = [LINE.format(at + i, s) for i, s in enumerate(ss[at : at + GROUP])]
        if len(head) + sum(map(len, lines)) > size:
            used, short = len(head), []
            for i, line in enumerate(lines):
                if short and used + len(line) > size:
                    break
                short.append(LINE.format(at + i, ss[at + i][: size // SHARE]))
                used += len(short[-1])
            lines = short
        out.append(head + "".join(lines))
        at += len(lines)
    return out


def serialised_arrays(titles: pa.Array, ss: pa.Array, size: int) -> pa.Array:
    """`serialised` of arrays; some rows at a time, as Python's strings take several times their bytes."""
    kind = pa.list_(pa.string())
    some = lambda at: pa.array([serialised(a, b, size) for a, b in zip(titles.slice(at, ROWS).to_pylist(), ss.slice(at, ROWS).to_pylist())], kind)
    return pa.concat_arrays([some(at) for at in range(0, len(titles), ROWS)] or [pa.array([], kind)])


def serialised_groups(title: Column, text: Column, size: int = 512) -> Column:
    """`serialised` over Arrow batches; null titles and texts count as empty."""

    def run(t: pa.Array, ss: pa.Array) -> pa.Array:
        return serialised_arrays(t, ss, size)

    return F.arrow_udf(run, "array<string>")(F.coalesce(title, F.lit("")), sentences(F.coalesce(text, F.lit(""))))


def oversize_split(text: Column, most: int = 8000) -> Column:
    """A text as it is, or windows of `most` characters where it is longer; blank ones go."""
    bare = strip(text)
    return F.when(F.length(bare) > most, windows(bare, most, 0)).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))


def hierarchical(chunks: DataFrame) -> DataFrame:
    """(doc_id, record_type, chunk_index, sentence_index, text, hash_id, parent_id, parent_text) of chunks with hash_id: each, and its sentences."""
    none = F.lit(None).cast("string")
    own = chunks.select("doc_id", F.lit("chunk").alias("record_type"), "chunk_index", F.lit(None).cast("int").alias("sentence_index"), F.col("chunk").alias("text"), "hash_id", none.alias("parent_id"), none.alias("parent_text"))
    each = chunks.select("doc_id", "chunk_index", F.posexplode(sentences(F.col("chunk"))).alias("sentence_index", "text"), "hash_id", "chunk")
    ident = F.sha2(F.encode(F.concat("hash_id", F.lit("\n"), F.col("sentence_index").cast("string"), F.lit("\n"), squeeze(F.col("text"))), "UTF-8"), 256)
    return own.unionByName(each.select("doc_id", F.lit("sentence").alias("record_type"), "chunk_index", "sentence_index", "text", ident.alias("hash_id"), F.col("hash_id").alias("parent_id"), F.col("chunk").alias("parent_text")))


def linked_pages(chunks: DataFrame, pages: DataFrame, fan: int = 4) -> DataFrame:
    """(doc_id, page_number, page, hash_id, child_hash_ids) of pages (doc_id, page_number, page): the `fan` hashed chunks at a page's places.

    Places count the chunks that are left after repeated ones went, so a repeated chunk moves those behind it; a page without chunks goes.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    own = chunks.withColumn("page_number", F.floor(place / fan) + 1).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "hash_id"))).alias("p"))
    ident = ingest.chunk_hash(F.concat(F.col("doc_id").cast("string"), F.lit(":page:"), F.col("page_number").cast("string")), F.col("page"))
    return pages.join(own, ["doc_id", "page_number"]).select("doc_id", "page_number", "page", ident.alias("hash_id"), F.transform("p", lambda x: x["hash_id"]).alias("child_hash_ids"))


def children(parents: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., child, hash_id, chunk): the chunks that parents link to, in their order."""
    links = parents.select(*keep, F.posexplode("child_hash_ids").alias("child", "hash_id"))
    return links.join(chunks.select("hash_id", "chunk"), "hash_id").select(*keep, "child", "hash_id", "chunk")


def collapsed(hits: DataFrame, parents: DataFrame, parent: str = "doc_id", most: int = 4) -> DataFrame:
    """(query_id, parent, rank, content, rows) of hits (query_id, parent, rank, text): each parent once, at its best hit's rank, with the texts of its first `most` hits."""
    got = hits.groupBy("query_id", parent).agg(F.min("rank").alias("rank"), F.slice(F.array_sort(F.collect_list(F.struct("rank", "text"))), 1, most).alias("r"))
    return got.join(parents, parent).select("query_id", parent, "rank", "content", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("rows"))


def first_of_title(paragraphs: DataFrame, title: str, order: list[str], sentences_col: str, glue: str = " ") -> DataFrame:
    """(title, text): of paragraphs with the same title the first, its sentences joined."""
    first = paragraphs.groupBy(title).agg(F.min(F.struct(*order, sentences_col)).alias("f"))
    return first.select(title, F.array_join(F.col(f"f.{sentences_col}"), glue).alias("text"))


def request_batches(rows: DataFrame, id_col: str, text_col: str, items: int = 64, chars: int = 24_000) -> DataFrame:
    """(ids, n_chars): rows put together for requests of at most `items` texts and `chars` characters, in each task in its order.

    A longer text is a request of its own; null and empty texts count as one character.  Which rows share a request follows from how
    rows are dealt to tasks: after a repartition other requests hold the same rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema[id_col].dataType)

    def run(batches):
        def request():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.list_(kind)), pa.array([size], pa.int64())], ["ids", "n_chars"])

        held, size = [], 0
        for b in batches:
            for ident, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (len(held) == items or size + n > chars):
                    yield request()
                    held, size = [], 0
                held.append(ident)
                size += n
        if held:
            yield request()

    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    return rows.select(id_col, size.alias("n")).mapInArrow(run, f"ids array<{rows.schema[id_col].dataType.simpleString()}>, n_chars long")
