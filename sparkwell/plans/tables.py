"""Queries over tables in shared folders: made, checked, counted, cloned, upserted."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell import catalogue as c
from sparkwell import storage
from sparkwell.operators import embedding, ingest, retrieval
from sparkwell.plans import hybrid
from sparkwell.versions import Table


@c.query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src1%' GROUP BY 1")
def scoped_counts(spark, sf_dir):
    return c.read(spark, sf_dir, "documents").where(F.col("source").startswith("src1")).groupBy("source").agg(F.count("*").alias("n"))


@c.query("SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'purchase' AND user_id % 2 = 0) OR (CAST(event_type = 'error' AS INTEGER) + CAST(user_id < 50 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) >= 2 AND event_type <> 'login')")
def boolean_filter(spark, sf_dir):
    """All of the first clauses, or at least two of three that should hold and none that mustn't."""
    should = [F.col("event_type") == "error", F.col("user_id") < 50, F.col("event_id") % 3 == 0]
    rows = c.read(spark, sf_dir, "events")
    must = (F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0)
    return rows.where(must | (at_least(should, 2) & (F.col("event_type") != "login"))).select("event_id", "event_type", "user_id")


def at_least(clauses: list, n: int):
    """True where n or more of the clauses hold; null counts as no."""
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in clauses), F.lit(0)) >= n


@c.query(
    f"""SELECT doc_id, CASE WHEN bool_or(doc_id % 3 <> 0) OVER (PARTITION BY text) THEN 'cached' ELSE 'fresh' END AS origin, array_to_string(list_transform({hybrid.EMBED.format("b")}, lambda x: CAST(x AS INTEGER)), ' ') AS vector, true AS again
FROM (SELECT doc_id, text, {hybrid.BUCKETS.format("text")} AS b FROM documents WHERE text IS NOT NULL)"""
)
def embedding_cache(spark, sf_dir):
    """Texts whose vectors are cached get these, others theirs once; a second call, when all are cached, gives the same vectors."""
    docs = c.read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    cache = Table(spark, storage.scratch(spark, "cache"))
    texts = docs.where("doc_id % 3 <> 0").select("text").distinct()
    cache.append(texts.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), embedding.hashed_vector(F.col("text")).alias("embedding")))
    first, fresh = ingest.with_vectors(docs, cache.read(), embedding.hashed_vector)
    before = cache.version().number
    cache.upsert(fresh, "hash", "hash")
    second, none = ingest.with_vectors(docs, cache.read(), embedding.hashed_vector)
    if not none.isEmpty():
        raise RuntimeError("a text is missing from the cache that all were put in")
    old = cache.read(before).select(F.col("hash").alias("old"))
    both = first.select("doc_id", "text", "embedding").join(second.select("doc_id", "text", F.col("embedding").alias("same")), ["doc_id", "text"])
    both = both.withColumn("hash", F.sha2(F.encode("text", "UTF-8"), 256)).join(old, F.col("hash") == F.col("old"), "left")
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ")
    return both.select("doc_id", F.when(F.col("old").isNull(), "fresh").otherwise("cached").alias("origin"), vector.alias("vector"), (F.col("embedding") == F.col("same")).alias("again"))


@c.query(
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'changed' WHEN source = 'src0' THEN 'old' ELSE 'new' END AS version, sha256(CASE WHEN lang = 'en' THEN 'changed: ' || coalesce(text, '') ELSE coalesce(text, '') END) AS text_sha256 FROM documents"
)
def table_lifecycle(spark, sf_dir):
    """A versioned table is made, filled from one source, filled up with what it lacks, changed in part, emptied by mistake, restored and checked."""
    table = Table(spark, storage.scratch(spark, "table"))
    table.ensure("doc_id long, hash_id string, source string, text string, version string", ("hash_id",))
    docs = c.read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("hash_id"), "source", F.coalesce("text", F.lit("")).alias("text"), "lang")
    table.insert(docs.where("source = 'src0'").drop("lang").withColumn("version", F.lit("old")), "hash_id")
    table.insert(docs.drop("lang").withColumn("version", F.lit("new")), "hash_id")
    changed = docs.where("lang = 'en'").drop("lang").withColumn("text", F.concat(F.lit("changed: "), "text")).withColumn("version", F.lit("changed"))
    good = table.upsert(changed, "hash_id", "doc_id")
    table.reset(table.read().schema)
    table.restore(good.number)
    out = table.read()
    storage.check_ready(out)
    return out.select("doc_id", "version", F.sha2("text", 256).alias("text_sha256"))


NAMED = ("community_docs", "community_entities", "communities")


@c.query(f"""WITH g AS (FROM ({c.ORACLE["graph_statistics"]})) SELECT "table", rows, CASE WHEN "table" IN {NAMED} THEN rows ELSE 0 END AS renamed FROM g""")
def graph_clone(spark, sf_dir):
    """All tables of a graph are written, cloned under another name with its communities renamed, and read back."""
    path = storage.scratch(spark, "graph")
    tables = c.doc_graph(spark, sf_dir)
    for name in NAMED:
        tables[name] = tables[name].withColumn("community", F.concat(F.lit("base:"), "community"))
    storage.write_graph(tables, path, "base")
    storage.clone_graph(spark, path, "base", "copy", list(tables), ids=("community",))
    parts = []
    for name, df in sorted(storage.read_graph(spark, path, "copy", list(tables)).items()):
        renamed = F.count_if(F.col("community").startswith("copy:")) if "community" in df.columns else F.lit(0).cast("long")
        parts.append(df.agg(F.count("*").alias("rows"), renamed.alias("renamed")).select(F.lit(name).alias("table"), "rows", "renamed"))
    return retrieval.all_of(parts)


# How names of a scope may be written, and what asks for all of it.
SCOPES, EVERYTHING = {"english": "en", "eng": "en", "french": "fr", "german": "de", "deutsch": "de", "spanish": "es"}, ("*", "all")


def scope(requested: str, domain: str, collection: str, aliases: dict[str, str]):
    """True for rows of the domains or collections that are asked for, by names parted by commas; aliases, in either case, name domains.

    Nothing, or a word for everything, asks for all rows.
    """
    names = [x for x in (x.strip() for x in requested.split(",")) if x]
    others = [x for x in names if x.lower() not in aliases]
    domains = sorted({aliases[x.lower()] for x in names if x.lower() in aliases})
    if not names or any(x.lower() in EVERYTHING for x in others):
        return F.lit(True)
    return F.coalesce(F.col(domain).isin(domains), F.lit(False)) | F.coalesce(F.col(collection).isin(others), F.lit(False))


@c.query(
    "SELECT 'ENGLISH, Deutsch' AS requested, count(*) AS n FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT 'src1, french', count(*) FROM documents WHERE source = 'src1' OR lang = 'fr' UNION ALL SELECT ' ', count(*) FROM documents UNION ALL SELECT 'src2,All', count(*) FROM documents"
)
def scope_aliases(spark, sf_dir):
    """How many documents scopes have that are asked for by other names."""
    docs = c.read(spark, sf_dir, "documents")
    return retrieval.all_of([docs.where(scope(x, "lang", "source", SCOPES)).agg(F.count("*").alias("n")).select(F.lit(x).alias("requested"), "n") for x in ("ENGLISH, Deutsch", "src1, french", " ", "src2,All")])
