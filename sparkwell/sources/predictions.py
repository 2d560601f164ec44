"""Predictions as one JSON document in one file, as evaluation scripts read them.

Each member of the document is a value, or rows of a DataFrame as an object or as an array.  Tasks write their rows as lines of text into a
folder beside the target; the driver's JVM then copies the parts' bytes one after the other, through a small buffer, so
that nobody holds the document, and it takes its place by a rename: a run that dies leaves the old file as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.storage import place


def quoted(text: Column) -> Column:
    """A string as JSON has it; null as null."""
    whole = F.to_json(F.struct(text.cast("string").alias("x")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


@dataclass
class Object:
    """{key: value, ...} of rows: null keys go, of equal keys one stays, the one with the largest `order` (or value)."""

    rows: DataFrame
    key: str
    value: str
    order: str | None = None
    ends = "{}"

    def lines(self) -> DataFrame:
        value = F.to_json(F.struct(F.col(self.value).alias("x")), {"ignoreNullFields": "false"})
        bare = F.substr(value, F.lit(6), F.length(value) - 6)
        rows = self.rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("string").alias("k"), bare.alias("v"), F.col(self.order or self.value).alias("o"))
        last = rows.groupBy("k").agg(F.max_by("v", F.col("o") if self.order else F.col("v")).alias("v"))
        return last.select(F.concat(quoted(F.col("k")), F.lit(": "), F.coalesce("v", F.lit("null"))).alias("line"))


@dataclass
class Array:
    """[{column: value, ...}, ...] of rows, in the order of the columns `order` if given."""

    rows: DataFrame
    order: tuple[str, ...] = ()
    ends = "[]"

    def lines(self) -> DataFrame:
        rows = self.rows.orderBy(*self.order) if self.order else self.rows
        return rows.select(F.to_json(F.struct(*self.rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_document(spark: SparkSession, members: dict, path: str) -> None:
    """A JSON object at path; members: name to a value, an Object or an Array, written in this order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    scratch = f"{path}.{uuid.uuid4().hex}"
    fs, folder = place(spark, scratch)
    try:
        for n, member in enumerate(members.values()):
            if isinstance(member, Object | Array):
                member.lines().select(F.concat(F.lit(","), "line").alias("line")).write.text(f"{scratch}/{n}")
        fs.mkdirs(folder)
        ready = place(spark, f"{scratch}/document")[1]
        out = fs.create(ready, False)

        def say(text: str) -> None:
            out.write(bytearray(text.encode()))

        say("{")
        for n, (name, member) in enumerate(members.items()):
            say(f"{',' if n else ''}\n{json.dumps(name)}: ")
            if not isinstance(member, Object | Array):
                say(json.dumps(member))
                continue
            say(member.ends[0] + "\n")
            first = True
            parts = fs.listStatus(place(spark, f"{scratch}/{n}")[1])
            for part in sorted((s.getPath() for s in parts if s.getPath().getName().startswith("part-") and s.getLen()), key=str):
                stream = fs.open(part)
                if first:
                    stream.read()  # the comma before the first line
                first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                stream.close()
            say(member.ends[1])
        say("\n}\n")
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(ready, place(spark, path)[1], options)
    finally:
        fs.delete(folder, True)


def write_answers(answers: DataFrame, path: str, key: str = "query_id") -> None:
    """answers (key, answer, facts): {"answer": {id: answer}, "sp": {id: facts}}."""
    write_document(answers.sparkSession, {"answer": Object(answers, key, "answer"), "sp": Object(answers, key, "facts")}, path)


def write_report(predictions: DataFrame, path: str, order: tuple[str, ...] = (), **summary) -> None:
    """The summary's values, and then the predictions as an array."""
    write_document(predictions.sparkSession, summary | {"predictions": Array(predictions, order)}, path)


def read_answers(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(id, answer, facts) of a document of answers, whose maps are exploded; an id that only one map has gets null from the other."""
    rows = spark.read.schema(f"answer map<string,string>, sp map<string,{value}>").json(path, multiLine=True)
    both = F.array_distinct(F.concat(F.map_keys("answer"), F.map_keys("sp")))
    return rows.select("answer", "sp", F.explode(both).alias("id")).select("id", F.try_element_at("answer", "id").alias("answer"), F.try_element_at("sp", "id").alias("facts"))
