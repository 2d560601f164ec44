"""What the operators of this package share: tables, shared storage, words and hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Learning never sees rows whose crc32(id as text) leaves this remainder modulo FOLDS.
FOLDS, HELD_OUT = 4, 2

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwell-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = delete_at_exit(spark, f"{shared_dir(spark)}/sparkwell/{what}-{uuid.uuid4().hex}")
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """path, which goes when the driver's JVM ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    return path


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of the columns has, in any case."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def frequent(rows: DataFrame, times: str, most: int) -> DataFrame:
    """The rows with the largest values of `times` (1 or more), about `most` of them and never more.

    The cut-off comes from a histogram of logarithms, of some hundreds of counts at any size, so nothing is sorted and no
    task gathers the rows.  A row that is left out has a share of less than about 1 / most of the sum of times.
    """
    step = F.floor(F.log2(times) * 8).cast("int")
    left, least = most, None
    for k, n in sorted(rows.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, k
    return rows.where(step >= least) if least is not None else rows.limit(0)


def key(names: list[str], *parts: Column) -> list[Column]:
    """128 bits: hashes from two seeds, as the constant in front makes them."""
    return [F.xxhash64(*parts).alias(names[0]), F.xxhash64(F.lit(1), *parts).alias(names[1])]


def row_key(id_col: str, text_col: str, names: list[str]) -> list[Column]:
    """Rows that share this share id and text; nulls are told from values."""
    i, t = F.col(id_col), F.col(text_col)
    return key(names, i, t, i.isNull(), t.isNull())


def held_out(id_col: str):
    """True for rows kept from learning; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def uniform(seed: int, *columns):
    """A number in [0, 1) that follows from the columns alone; rows that are equal in them share it."""
    return F.xxhash64(*columns, F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)


def text_key(id_col: str, text_col: str):
    """64 bits of a row's id and text, nulls told from values: what samples of rows are drawn by."""
    i, t = F.col(id_col), F.col(text_col)
    return F.xxhash64(i, t, i.isNull(), t.isNull())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, kept for up to `most` words."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.most, self.digest = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.digest(word)
        return found


def slices(batch, text_at: int, most_bytes: int = 8 << 20):
    """Parts of an Arrow batch with about most_bytes of text each, so memory doesn't follow long texts."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def streamed(df: DataFrame, keys: list[str], fold, schema) -> DataFrame:
    """The rows that fold gives for each run of rows (as dicts) with equal keys.

    fold takes an iterator: a run is read a few rows at a time and its size doesn't matter.  What is to be one run must lie in
    one partition in order.  Without keys each row is a run.
    """

    def run(batches):
        from itertools import groupby, islice

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)]
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        runs = (group for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys))) if keys else ([r] for r in rows)
        out = (y for group in runs for y in fold(group))
        while part := list(islice(out, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], schema.names)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on for other tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return
