"""From documents to identified chunks: windows, hashes, insert-if-absent, backfill plans, linearised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions.text import squeeze, strip, windows
from sparkwell.storage import exists

RESERVED = ("text", "chunk_index", "hash_id", "embedding")


def check_columns(extra: list[str]) -> None:
    """User columns must not take a reserved name."""
    if taken := sorted(set(extra) & set(RESERVED)):
        raise ValueError(f"reserved columns: {', '.join(taken)}")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., chunk_index, chunk): a row for each window that isn't blank."""
    check_columns(list(keep))
    return docs.select(id_col, *keep, F.posexplode(windows(F.col(text_col), size, overlap)).alias("chunk_index", "chunk"))


def chunk_hash(key: Column, chunk: Column) -> Column:
    """Identity of a chunk: its document's key and its text up to white space."""
    return F.sha2(F.encode(F.concat(key, F.lit("\n"), squeeze(chunk)), "UTF-8"), 256)


def document_key(document_id: Column, collection: Column, source: Column, title: Column, fallback: Column) -> Column:
    """The first of: id, collection:source, collection:title, fallback; empty values count as missing."""
    filled = lambda c: F.when(c != "", c)
    pair = lambda c: F.when(filled(c).isNotNull(), F.concat(F.coalesce(collection, F.lit("")), F.lit(":"), c))
    return F.coalesce(filled(document_id), pair(source), pair(title), fallback)


def hashed_chunks(docs: DataFrame, **how) -> DataFrame:
    """Chunks with hash_id; of equal ones in a document the first stays.  A null id has a key of its own, which no text has."""
    rows = chunks(docs, **how)
    rows = rows.withColumn("hash_id", chunk_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.col("chunk")))
    return rows.groupBy("hash_id").agg(F.min(F.struct("chunk_index", "doc_id", "chunk")).alias("first")).select("first.doc_id", "first.chunk_index", "first.chunk", "hash_id")


def absent(new: DataFrame, existing: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of new whose key isn't among existing: what an idempotent insert appends."""
    return new.join(existing.select(key), key, "left_anti")


def insert(new: DataFrame, path: str, key: str = "hash_id") -> int:
    """Appends to the Parquet table at path the rows that it lacks, one for each key; returns how many."""
    spark = new.sparkSession
    rows = new.dropDuplicates([key])
    if exists(spark, path):
        rows = absent(rows, spark.read.parquet(path), key)
    rows = rows.cache()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def backfill_plan(rows: DataFrame, key: Column, text: str, current: str, order: list[str]) -> DataFrame:
    """rows with hash_id and action: skip (blank text), delete (a later duplicate), keep (unchanged) or update."""
    found = rows.withColumn("hash_id", F.when(F.trim(F.col(text)) != "", chunk_hash(key, F.col(text))))
    # rows without a hash aren't compared, so they are dealt by their order
    deal = F.when(F.col("hash_id").isNull(), F.xxhash64(*order))
    nth = F.row_number().over(Window.partitionBy("hash_id", deal).orderBy(*order))
    action = F.when(F.col("hash_id").isNull(), "skip").when(nth > 1, "delete").when(F.col(current).eqNullSafe(F.col("hash_id")), "keep").otherwise("update")
    return found.withColumn("action", action)


def linearize(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, row_text): each row as "column: value" joined by pipes; missing and empty values are left out."""
    parts = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return rows.select(id_col, F.concat_ws(" | ", *parts).alias("row_text"))


def table_lines(table: Column) -> Column:
    """An array of rows, the first of which is the header, as a line for each other row: "column: value" joined by pipes, as far as both go."""
    header = F.get(table, F.lit(0))
    cells = lambda row: F.zip_with(F.slice(header, F.lit(1), F.size(row)), F.slice(row, F.lit(1), F.size(header)), lambda a, b: F.concat(a, F.lit(": "), b))
    rows = F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0)))
    return F.array_join(F.transform(rows, lambda row: F.array_join(cells(row), " | ")), "\n")


def document_with_table(before: Column, table: Column, after: Column) -> Column:
    """A document of sentences before a table, the table's rows as lines, and sentences after it, with blank lines between; what is missing goes.

    Sentences of two characters or fewer are noise.
    """
    said = lambda part: F.nullif(strip(F.array_join(F.filter(part, lambda s: F.length(strip(s)) > 2), " ")), F.lit(""))
    return F.array_join(F.array_compact(F.array(said(before), F.when(F.size(table) > 0, table_lines(table)), said(after))), "\n\n")


def documents_from_chunks(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks joined back into texts, in order of (chunk_index, chunk)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "\n").alias("text"), F.count("*").alias("n_chunks"))


def apply_backfill(plan: DataFrame, current: str) -> DataFrame:
    """The table after a backfill plan: later duplicates go, updated rows take their hash, others stay as they were."""
    kept = plan.where("action <> 'delete'").withColumn(current, F.when(F.col("action") == "update", F.col("hash_id")).otherwise(F.col(current)))
    return kept.drop("action") if current == "hash_id" else kept.drop("action", "hash_id")


def with_vectors(rows: DataFrame, cache: DataFrame, provider, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, what to add to the cache): vectors by the text's hash from cache (hash, embedding), others from the provider.

    provider maps a column of texts to a column of vectors and meets each missing text once.  Null texts have no vector.
    """
    keyed = rows.withColumn("__hash", F.sha2(F.encode(F.col(text), "UTF-8"), 256))
    known = cache.select(F.col("hash").alias("__hash"), "embedding").dropDuplicates(["__hash"])
    missing = keyed.where(F.col("__hash").isNotNull()).select("__hash", text).dropDuplicates(["__hash"]).join(known, "__hash", "left_anti")
    fresh = missing.select("__hash", provider(F.col(text)).alias("embedding"))
    out = keyed.join(known.unionByName(fresh), "__hash", "left").drop("__hash")
    return out, fresh.withColumnRenamed("__hash", "hash")
