"""Merkle dataset manifest: hash trees over the rows of a table, kept as a node store of level-partitioned Parquet.

A row is a leaf.  Leaves are sorted by ranges of (source, id), never by source, and numbered in order; of each range only its first and last
source and some counts come to the driver.  A level is built from the one below by reading it in order, in blocks of SPAN nodes of one source, each of which
gives STRIDE levels at once; so a hot source is many blocks, and the number of passes is the logarithm of its size to the
base SPAN.  The sources' subroots are the leaves of one more tree, whose root is the manifest's.  Proofs go down the same way:
the nodes of a block, the proof of the block's top and the leaves are merged by coordinate and read once.

Defined cases: a null value is told from an empty one; rows with a null id come first in their source, rows with equal ids go by
leaf; repeated rows are leaves of their own; a null source is a source, before all others; very long texts are hashed whole and
never shuffled; other columns are ignored; an empty table gives no rows and no root.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm.common import delete_at_exit, shared_dir, streamed, table, trim, written

#: Children of a node; levels that one pass over a block builds, and the block's nodes.
ARITY, STRIDE = 3, 6
SPAN = ARITY**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def told(*values: Column) -> Column:
    """The digest of some values: each its UTF-8 byte count, a colon and itself, or - where it is null."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)), 256)


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (with a column tree) as a table sorted by tree and order, with pos: the row's number in its tree, from 0."""
    schema = T.StructType([*leaves.schema.fields, *T.StructType.fromDDL("part int, row long, i long, first boolean").fields])
    at = leaves.columns.index("tree")

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, row, i, tree, first = TaskContext.get().partitionId(), 0, -1, None, True
        for batch in batches:
            number, firsts = [], []
            for t in batch.column(at).to_pylist():
                if t != tree and i >= 0:
                    i, first = -1, False
                i, tree = i + 1, t
                number.append(i)
                firsts.append(first)
            n = batch.num_rows
            more = [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(number, pa.int64()), pa.array(firsts, pa.bool_())]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)
        trim()

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    runs = written(leaves.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(count, schema), "merkle-leaves")
    ends = runs.groupBy("part").agg(
        F.min_by("tree", "row").alias("begins"),
        F.max_by("tree", "row").alias("ends"),
        F.sum(F.col("first").cast("long")).alias("n_first"),
        (F.max_by("i", "row") + 1).alias("n_last"),
        F.min("first").alias("one"),
    )
    before, tree, sofar = [], None, 0
    for k, r in enumerate(sorted(ends.collect())):  # a row for each range, however many rows it has
        had = sofar if k and r.begins == tree else 0
        before.append((r.part, had))
        sofar, tree = (had + r.n_first if r.one else r.n_last), r.ends
    before = leaves.sparkSession.createDataFrame(before, "part int, had long")
    return runs.join(F.broadcast(before), "part").select(*leaves.columns, (F.col("i") + F.when(F.col("first"), F.col("had")).otherwise(0)).alias("pos"))


@dataclass
class Store:
    """Trees in a folder: nodes by level, as (tree, pos, hash, top, level).

    top marks the hash that stands for a tree, by the stride that found it; where it is alone in its block it
    stands there unmarked, too.
    """

    spark: SparkSession
    path: str
    kind: T.DataType
    strides: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("tree", self.kind), *T.StructType.fromDDL("pos long, hash string, top int, level int").fields])

    def add(self, nodes: DataFrame) -> None:
        nodes.select(*self.schema.names).write.mode("append").partitionBy("level").parquet(self.path)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def tops(self) -> DataFrame:
        return self.nodes().where("top is not null")


def in_blocks(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def build(leaves: DataFrame, path: str) -> Store:
    """The trees over leaves (tree, pos, hash), each level from the one below."""
    store = Store(leaves.sparkSession, path, leaves.schema["tree"].dataType)
    store.add(leaves.select("tree", "pos", "hash", F.lit(None).cast("int").alias("top"), F.lit(0).alias("level")))
    while True:
        base = store.strides * STRIDE
        below = store.nodes().where((F.col("level") == base) & F.col("top").isNull())
        if below.isEmpty():
            return store

        def climb(rows, base=base):
            rows = list(rows)  # a block
            tree, block, hashes = rows[0]["tree"], rows[0]["block"], [r["hash"] for r in rows]
            alone = block == 0 and len(hashes) < SPAN
            if alone and len(hashes) == 1:
                yield tree, 0, hashes[0], base // STRIDE, base
                return
            for k in range(1, STRIDE + 1):
                hashes = [joined(*hashes[j : j + ARITY]) for j in range(0, len(hashes), ARITY)]
                for j, h in enumerate(hashes):
                    yield tree, block * ARITY ** (STRIDE - k) + j, h, base // STRIDE if alone and len(hashes) == 1 else None, base + k
                if alone and len(hashes) == 1:
                    return

        blocks = below.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "hash")
        store.add(streamed(in_blocks(blocks, "pos"), ["tree", "block"], climb, store.schema))
        store.strides += 1


def prove(store: Store, leaves: DataFrame, above: DataFrame, each, schema: T.StructType) -> DataFrame:
    """What each(leaf's row, its path, its tree's top) gives for the leaves, which have tree, pos, hash and other columns.

    above: (tree, path) for each tree.  A path is the siblings of a node and of the nodes above it, level by level:
    those before it, a comma, those after it; levels are parted by semicolons.
    """
    tops = store.tops().select(F.col("tree").alias("t"), "top", "level", F.col("hash").alias("sub"))
    heads = written(above.join(tops, F.col("tree").eqNullSafe(F.col("t"))).drop("t"), "merkle-heads")
    proofs = None
    for stride in reversed(range(store.strides)):
        base = stride * STRIDE
        head = heads.where(F.col("top") == stride).select("tree", F.lit(0).cast("long").alias("block"), "level", "path", "sub")
        if proofs is not None:
            head = head.unionByName(proofs.select("tree", F.col("pos").alias("block"), F.lit(base + STRIDE).alias("level"), "path", "sub"))
        rows = store.nodes().where((F.col("level") >= max(base, 1)) & (F.col("level") < base + STRIDE) & F.col("top").isNull()).drop("top")
        if not stride:
            rows = rows.unionByName(leaves.withColumn("level", F.lit(0)), allowMissingColumns=True)
        block = F.expr(f"pos div cast(power({ARITY}, {STRIDE} + {base} - level) as long)")
        rows = rows.withColumn("block", block).unionByName(head, allowMissingColumns=True)
        out = schema if stride == 0 else T.StructType([T.StructField("tree", store.kind), *T.StructType.fromDDL("pos long, path string, sub string").fields])
        rows = in_blocks(rows, F.col("hash").isNotNull(), F.desc("level"), "pos")
        proofs = streamed(rows, ["tree", "block"], lambda rows, last=stride == 0: merge(rows, each if last else None), out)
        if stride:
            proofs = written(proofs, "merkle-paths")
    return leaves.sparkSession.createDataFrame([], schema) if proofs is None else proofs


def merge(rows, each):
    """One block: its head, then its nodes from the highest level to the base, each in order."""
    head, above, level, here = None, {}, None, []
    for row in rows:
        if row["hash"] is None:
            head = row
            above = {row["block"]: row["path"]}
            continue
        if row["level"] != level:
            above, level, here = (paths(here, above) if here else above), row["level"], []
        here.append(row)
    found = {here[0]["pos"]: head["path"]} if level == head["level"] else paths(here, above)
    for row in here:
        path = found[row["pos"]]
        yield each(row, path, head["sub"]) if each else (row["tree"], row["pos"], path, head["sub"])


def paths(nodes: list, above: dict) -> dict:
    """Position to path for the nodes of one level, from the paths of the level above."""
    out = {}
    hashes = {r["pos"]: r["hash"] for r in nodes}
    for q in hashes:
        run = [ARITY * (q // ARITY) + k for k in range(ARITY)]
        step = ",".join("".join(hashes[p] for p in side if p in hashes) for side in ([p for p in run if p < q], [p for p in run if p > q]))
        up = above[q // ARITY]
        out[q] = f"{step};{up}" if up else step
    return out


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and the siblings of its path give."""
    for step in path.split(";") if path else ():
        left, _, right = step.partition(",")
        leaf = joined(left, leaf, right)
    return leaf


def manifest(docs: DataFrame, path: str, fields=FIELDS, tree_col="source", id_col="doc_id", other: Column | None = None):
    """(leaves, store of the trees, store of the tree over their tops): leaves has tree, pos, hash, id, other and is sorted.

    other: a digest to be held against each leaf by `verified`, null where it is the leaf's own.
    """
    leaves = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), told(*(F.col(f) for f in fields)).alias("hash"), (F.lit(None).cast("string") if other is None else other).alias("other"), F.monotonically_increasing_id().alias("tie"))
    leaves = numbered(written(leaves, "merkle-rows"), ["id", "hash", "tie"]).drop("tie")
    trees = build(leaves, f"{path}/trees")
    tops = numbered(trees.tops().select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "hash"), ["source"])
    return leaves, trees, build(tops, f"{path}/top"), tops


def verified(leaves: DataFrame, trees: Store, top: Store, tops: DataFrame, id_type: T.DataType) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (from `other` where there is one), verified for every leaf."""
    found = top.tops().first()
    root = found.hash if found else None
    above = top.tops().select("tree", F.lit("").alias("path"))
    source = T.StructType([T.StructField("tree", trees.kind), T.StructField("path", T.StringType())])
    subroots = prove(top, tops, above, lambda row, path, sub: (row["source"], path), source)

    def check(row, path, sub):
        got = folded(row["other"] or row["hash"], path)
        return row["id"], row["hash"], sub, root, joined(path.replace(",", "").replace(";", "")), got, got == root

    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    return prove(trees, leaves, subroots, check, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and check, texts of half of them without their line ends as a tampered copy would have them."""
    docs = table(spark, sf_dir, "documents")
    cut = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    bad = F.when(cut, told(*(F.translate("text", "\n", "") if f == "text" else F.col(f) for f in FIELDS)))
    path = delete_at_exit(spark, f"{shared_dir(spark)}/sparkwell/merkle-{uuid.uuid4().hex}")
    parts = manifest(docs, path, other=bad)
    return verified(*parts, docs.schema["doc_id"].dataType).withColumnRenamed("id", "doc_id")


def _told(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(v{i}))::VARCHAR || ':' || v{i}, '-')" for i in range(len(FIELDS))]
    values = ", ".join(f"{text if f == 'text' else f}::VARCHAR AS v{i}" for i, f in enumerate(FIELDS))
    return f"(SELECT sha256({' || '.join(parts)}) FROM (SELECT {values}))"


#: CRC-32 bit by bit; its last bit is the complement of the register's.
OP12_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT *, row_number() OVER () AS rid,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) % 2 = 1 AS cut
  FROM documents),
leaf AS (
  SELECT rid, doc_id, source, {_told('text')} AS leaf, {_told("CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END")} AS other FROM doc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
node AS (
  SELECT source, 0 AS level, pos, leaf AS hash, n FROM ranked
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 2) // 3) FROM node WHERE n > 1 GROUP BY source, level, pos // 3),
sub AS (SELECT source, level AS height, hash, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper_node AS (
  SELECT 0 AS level, pos, hash, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 2) // 3) FROM upper_node WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT level AS height, hash FROM upper_node WHERE n = 1),
step AS (
  SELECT r.rid, m.level AS k, coalesce(string_agg(m.hash, '' ORDER BY m.pos) FILTER (m.pos < r.pos // (3 ** m.level)::BIGINT), '') AS l, coalesce(string_agg(m.hash, '' ORDER BY m.pos) FILTER (m.pos > r.pos // (3 ** m.level)::BIGINT), '') AS r
  FROM ranked r JOIN sub s ON r.source IS NOT DISTINCT FROM s.source
  JOIN node m ON m.source IS NOT DISTINCT FROM r.source AND m.level < s.height AND m.pos // 3 = r.pos // (3 ** (m.level + 1))::BIGINT GROUP BY r.rid, m.level
  UNION ALL
  SELECT r.rid, s.height + m.level, coalesce(string_agg(m.hash, '' ORDER BY m.pos) FILTER (m.pos < s.pos // (3 ** m.level)::BIGINT), ''), coalesce(string_agg(m.hash, '' ORDER BY m.pos) FILTER (m.pos > s.pos // (3 ** m.level)::BIGINT), '')
  FROM ranked r JOIN sub s ON r.source IS NOT DISTINCT FROM s.source
  JOIN upper_node m ON m.level < (SELECT height FROM root) AND m.pos // 3 = s.pos // (3 ** (m.level + 1))::BIGINT GROUP BY r.rid, s.height, m.level),
fold AS (
  SELECT rid, 0 AS k, other AS hash FROM ranked
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(s.l || f.hash || s.r) FROM fold f JOIN step s ON f.rid = s.rid AND f.k = s.k),
last AS (SELECT rid, arg_max(hash, k) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY rid)
SELECT r.doc_id, r.leaf, s.hash AS subroot, root.hash AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.hash AS verified
FROM ranked r JOIN sub s ON r.source IS NOT DISTINCT FROM s.source JOIN last USING (rid) LEFT JOIN proof p USING (rid), root
"""
