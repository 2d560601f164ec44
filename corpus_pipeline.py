"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents.  Models are learned from the labelled documents of sf_dir, whatever earlier stages have dropped,
and applied to docs.

Defined cases: null and empty texts fail the base rule and go, as do texts of which deduplication leaves no word; a null id
is a value like others; repeated rows count as copies, of which one stays; very long texts are cut into pieces by the last
stage alone; other columns are carried along up to it; without a usable label (none, or of one class) the classifier keeps
all and the rules are the base rule; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from sparkwell.llm.common import table, written

#: Near-duplicates of the pipeline: five-word shingles, a similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 4, 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores as good."""
    return quality_classifier.keep_good(docs, quality_classifier.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject."""
    return quality_rules.keep_good(docs, quality_rules.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; n_chars follows, and texts of which no word is left go."""
    out = line_dedup.without_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return jaccard_join.one_of_each(docs, SHINGLE, NUM, DEN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("best_fit_packing", pack),
]
#: Learned models and a tokenizer decide here, which SQL can't state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
