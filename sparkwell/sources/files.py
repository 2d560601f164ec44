"""Readers and writers of the formats that corpora and benchmarks come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkwell.storage import exists, replace_table


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text): a row per file; the title is the file's name in words."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    # a path has its odd characters as percent escapes, but a plus sign as itself
    name = F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
    return rows.select("path", F.initcap(F.regexp_replace(name, "[_-]", " ")).alias("title"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank ones, malformed ones and those whose values don't fit the schema are left out, whatever columns are read."""
    kind = StructType.fromDDL(schema)
    bad = "__bad" + "_" * max(map(len, kind.names), default=0)
    whole = StructType([*kind.fields, StructField(bad, StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return rows.where(F.col("r").isNotNull() & F.col(f"r.{bad}").isNull()).select(*(F.col("r").getField(n).alias(n) for n in kind.names))


def zipped_lines(spark: SparkSession, path: str, first: int = 1, last: int = 0) -> DataFrame:
    """(path, line_no, line): lines first to last (0: to the end) of each zip file's first member, streamed."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["path", "line_no", "line"])

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if not z.namelist():
                        continue
                    held = []
                    with z.open(z.namelist()[0]) as f:
                        for n, line in enumerate(io.TextIOWrapper(f, "utf-8"), 1):
                            if n >= first and (last <= 0 or n <= last):
                                held.append((name, n, line.rstrip("\n")))
                            if len(held) == 5000:
                                yield batch(held)
                                held = []
                    if held:
                        yield batch(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line_no long, line string")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, score) of a tab-separated file with a header; short rows go, of repeated pairs the last stays."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, corpus_id string, score int", mode="PERMISSIVE")
    rows = rows.where("query_id is not null and corpus_id is not null and score is not null").withColumn("__n", F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy("query_id", "corpus_id").orderBy(F.desc("__n")))
    return rows.withColumn("__r", last).where("__r = 1").drop("__n", "__r")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; its types are guessed unless a schema is given."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def export_texts(rows: DataFrame, path: str, name_col: str, text_col: str) -> DataFrame:
    """(name, written): a text file for each row in the folder at path, which tasks must be able to reach; files that are there stay.

    Names keep letters, digits, points, dashes and underscores, and end in .txt; nulls count as empty.  A file is written beside its
    place and then moved, so a task that is run again leaves no halves.  Of rows with the same name one is written.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            there = [x.type != fs.FileType.NotFound for x in store.get_file_info([f"{root}/{n}" for n in names])]
            for n, t, old in zip(names, texts, there):
                if not old:
                    part = f"{root}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(t.encode())
                    store.move(part, f"{root}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([not x for x in there], pa.bool_())], ["name", "written"])

    safe = F.concat(F.regexp_replace(F.coalesce(F.col(name_col).cast("string"), F.lit("")), r"[^\p{L}\p{N}._-]+", "_"), F.lit(".txt"))
    once = rows.select(safe.alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["name"])
    return once.mapInArrow(run, "name string, written boolean")


def upsert(new: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """The table at path with new rows in place of those with the same key; of several the last by `order`."""
    spark = new.sparkSession
    both = new.withColumn("__p", F.lit(1))
    if exists(spark, path):
        both = both.unionByName(spark.read.parquet(path).withColumn("__p", F.lit(0)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__p"), F.desc(order)))
    return both.withColumn("__n", nth).where("__n = 1").drop("__n", "__p")


def upsert_into(new: DataFrame, path: str, key: str, order: str) -> None:
    """`upsert`, written in place of the table at path."""
    replace_table(upsert(new, path, key, order), path)
