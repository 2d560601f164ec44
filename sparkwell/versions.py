"""Tables of versions: snapshots of Parquet folders, each made known by one file that only one writer can put in place.

A table is a folder with `data/`, whose parts are never changed once written, and `versions/`, whose files name the parts of each
version.  A writer puts its rows in a new part and then moves version n + 1 in place by a rename that fails if it is
there: until then readers see version n, and a writer that has died has changed nothing.  Of writers that began from the
same version one wins, and the others raise Conflict or, where the operation allows it, begin again from what has won.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.storage import place


class Conflict(RuntimeError):
    """Another writer has put this version in place first."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[str, ...]
    schema: str
    batches: dict
    what: str

    @classmethod
    def of(cls, text: str) -> Version:
        x = json.loads(text)
        return cls(x["number"], tuple(x["parts"]), x["schema"], x["batches"], x["what"])

    def text(self) -> str:
        return json.dumps({"number": self.number, "parts": self.parts, "schema": self.schema, "batches": self.batches, "what": self.what})


#: How often an operation begins again after a conflict.
TRIES = 5


class Table:
    """A table in the folder at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # Versions

    def numbers(self) -> list[int]:
        fs, p = place(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def version(self, number: int | None = None) -> Version | None:
        """The last version, or an earlier one; None where there is no table."""
        known = self.numbers()
        if number is None and not known:
            return None
        number = known[-1] if number is None else number
        if number not in known:
            raise ValueError(f"no version {number} at {self.path}")
        fs, p = place(self.spark, self.named(number))
        stream = fs.open(p)
        try:
            return Version.of(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def named(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def commit(self, new: Version) -> Version:
        """Makes a version known, whole or not at all."""
        jvm = self.spark.sparkContext._jvm
        fs, ready = place(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(ready, False)
        stream.write(bytearray(new.text().encode()))
        stream.close()
        _, target = place(self.spark, self.named(new.number))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(ready, target, options)
        except Exception as e:
            fs.delete(ready, False)
            if fs.exists(target):
                raise Conflict(f"version {new.number} of {self.path} is another writer's") from e
            raise
        return new

    # Reading

    def exists(self) -> bool:
        return bool(self.numbers())

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        if v is None:
            raise ValueError(f"no table at {self.path}")
        schema = T.StructType.fromJson(json.loads(v.schema))
        if not v.parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{x}" for x in v.parts))

    def history(self) -> list[Version]:
        return [self.version(n) for n in self.numbers()]

    # Writing

    def write(self, df: DataFrame) -> str:
        """Rows as a new part, which no version has yet."""
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{part}")
        return part

    def next(self, base: Version | None, parts: tuple[str, ...], schema: T.StructType, what: str, batch: tuple[str, int] | None = None) -> Version:
        batches = dict(base.batches if base else {}) | ({batch[0]: batch[1]} if batch else {})
        return self.commit(Version((base.number if base else 0) + 1, parts, schema.json(), batches, what))

    def seen(self, batch: tuple[str, int] | None, base: Version | None) -> bool:
        """True for a batch (name of a stream, number) that a version has, or a later one of its stream."""
        return bool(batch and base and base.batches.get(batch[0], -1) >= batch[1])

    def replace(self, df: DataFrame, batch: tuple[str, int] | None = None, base: Version | None = None, what: str = "replace") -> Version:
        """df in place of what was there; df may read this table.  base: the version that df was made from, where another's rows must not get lost."""
        base = base or self.version()
        if self.seen(batch, base):
            return base
        return self.next(base, (self.write(df),), df.schema, what, batch)

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        """Adds rows; they conflict with nothing, so a writer that was overtaken goes on from what is there then."""
        part = None
        for _ in range(TRIES):
            base = self.version()
            if self.seen(batch, base):
                return base
            if base is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in self.read().schema]:
                raise ValueError(f"columns {df.columns} don't fit the table's {self.read().columns}")
            part = part or self.write(df)
            try:
                return self.next(base, (*(base.parts if base else ()), part), df.schema, "append", batch)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: overtaken {TRIES} times")

    def attempt(self, change: Callable[[Version | None], Version]) -> Version:
        """change from the last version, and again from the next where another writer was first."""
        for _ in range(TRIES):
            try:
                return change(self.version())
            except Conflict:
                continue
        raise Conflict(f"{self.path}: overtaken {TRIES} times")

    def insert(self, new: DataFrame, key: str, batch: tuple[str, int] | None = None) -> int:
        """Adds the rows whose key the table lacks, one for each key (a null key is one); returns how many."""
        added = 0

        def change(base):
            nonlocal added
            added = 0
            if self.seen(batch, base):
                return base
            rows = new.dropDuplicates([key])
            if base is not None:
                old = self.read(base.number).select(F.col(key).alias("__old")).distinct()
                rows = rows.join(old, F.col(key).eqNullSafe(F.col("__old")), "left_anti")
            part = self.write(rows)
            added = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{part}").count()
            schema = T.StructType.fromJson(json.loads(base.schema)) if base else new.schema
            return self.next(base, (*(base.parts if base else ()), part), schema, "insert", batch)

        self.attempt(change)
        return added

    def upsert(self, new: DataFrame, key: str, order: str, batch: tuple[str, int] | None = None) -> Version:
        """New rows in place of those with the same key; of several new ones the last by `order`."""

        def change(base):
            if self.seen(batch, base):
                return base
            last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
            rows = new.withColumn("__n", last).where("__n = 1").drop("__n")
            if base is None:
                return self.next(base, (self.write(rows),), new.schema, "upsert", batch)
            old = self.read(base.number)
            kept = old.join(new.select(F.col(key).alias("__key")).distinct(), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
            return self.next(base, (self.write(kept.unionByName(rows.select(*old.columns))),), old.schema, "upsert", batch)

        return self.attempt(change)

    def ensure(self, schema: str | T.StructType, needs: tuple[str, ...] = ()) -> bool:
        """Makes an empty table where there is none, or one without the columns that it needs; True if it did."""
        base = self.version()
        if base is not None and set(needs) <= {f["name"] for f in json.loads(base.schema)["fields"]}:
            return False
        self.reset(schema)
        return True

    def reset(self, schema: str | T.StructType) -> Version:
        """An empty table in place of whatever was there; earlier versions stay readable."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self.attempt(lambda base: self.next(base, (), kind, "reset"))

    def restore(self, number: int) -> Version:
        """An earlier version again, as the next."""
        old = self.version(number)
        return self.attempt(lambda base: self.next(base, old.parts, T.StructType.fromJson(json.loads(old.schema)), f"restore {number}"))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the versions before the last `keep`, and parts that none of those has; returns how many parts went.

        Parts of writers at work look like parts of dead ones: not to be called while others write.
        """
        known = self.numbers()
        kept = {p for n in known[-keep:] for p in self.version(n).parts}
        fs, data = place(self.spark, f"{self.path}/data")
        gone = 0
        for n in known[:-keep]:
            fs.delete(place(self.spark, self.named(n))[1], False)
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in kept:
                gone += fs.delete(s.getPath(), True)
        return gone
