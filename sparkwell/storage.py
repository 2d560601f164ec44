"""Tables in shared folders: creating, checking, cloning and clearing them; the folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """A session needs a checkpoint folder that driver and executors share; in local mode one of our own is made where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkwell-"))


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's classes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = place(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the driver's JVM ends."""
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    fs, p = place(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what several readers use is made once, and lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: str, needs: tuple[str, ...] = ()) -> bool:
    """Makes an empty table where there is none, or one without the columns that it needs; True if it did."""
    if exists(spark, path) and set(needs) <= set(spark.read.parquet(path).columns):
        return False
    reset_table(spark, path, schema)
    return True


def reset_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table in place of whatever was there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df in place of the table at path, from which df may have been read: written beside it, then moved.

    The old table is moved aside before and deleted last, so a crash loses neither; `recover` puts it back.  Readers that must
    never find the path empty, and writers that may meet, use versions.Table.
    """
    spark = df.sparkSession
    recover(spark, path)
    fs, p = place(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    aside = place(spark, f"{path}.aside")[1]
    if fs.exists(p) and not fs.rename(p, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(place(spark, fresh)[1], p):
        fs.rename(aside, p)
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a writer had moved aside when it died; True if there was one."""
    fs, p = place(spark, path)
    aside = place(spark, f"{path}.aside")[1]
    if not fs.exists(aside):
        return False
    if fs.exists(p):  # it died after the move
        fs.delete(aside, True)
        return False
    return fs.rename(aside, p)


def count_where(spark: SparkSession, path: str, condition: str = "true") -> int:
    return spark.read.parquet(path).where(condition).count()


def check_ready(rows: DataFrame, column: str = "hash_id") -> None:
    """Raises where rows lack the column's value."""
    missing = rows.where(F.col(column).isNull() | (F.col(column) == "")).count()
    if missing:
        raise ValueError(f"{missing} rows without {column}: run the backfill first")


def find_data(spark: SparkSession, folder: str, preferred: str, pattern: str, least: int = 100, part: str = "") -> list[str]:
    """The preferred file of a folder if it is there, else the files of the pattern with more than `least` bytes and `part` in their path."""
    if exists(spark, f"{folder}/{preferred}"):
        return [f"{folder}/{preferred}"]
    fs, p = place(spark, f"{folder}/{pattern}")
    return sorted(x for s in fs.globStatus(p) or [] if s.getLen() > least and part in (x := s.getPath().toString()))


def write_graph(tables: dict[str, DataFrame], path: str, graph: str) -> None:
    """Writes a graph's tables, in place of those of the same graph; others of the same folder stay."""
    for name, df in tables.items():
        df.withColumn("graph", F.lit(graph)).write.partitionBy("graph").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, graph: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").where(F.col("graph") == graph).drop("graph") for n in names}


def clone_graph(spark: SparkSession, path: str, source: str, target: str, names: list[str], ids: tuple[str, ...] = ("community_id",)) -> None:
    """A copy of a graph's tables under another name, which its ids take up as well."""
    tables = read_graph(spark, path, source, names)
    for n, df in tables.items():
        for c in set(ids) & set(df.columns):
            df = df.withColumn(c, F.replace(c, F.lit(source), F.lit(target)))
        tables[n] = df
    write_graph(tables, path, target)
