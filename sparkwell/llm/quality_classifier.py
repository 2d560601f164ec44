"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the pairwise
interactions cost linear time by the sum-of-squares identity.

The metadata are a text's own: characters, bytes, lines, blank lines and bytes to a character.

Defined cases: a null or empty text has no words and zero statistics, and gets a score like any other; a null id
gives a null id; repeated rows each get a row; long texts are read whole; other columns of the input are ignored.
A label goes to every row of its id; where labelled rows are drawn to learn from, a row that repeats another counts once.
Without a labelled row of each class there is nothing to learn: every score is PRIOR, and `keep_good`, which then has no
grounds to reject a document, keeps all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm.common import held_out, slices, table, text_key, trim, uniform
from sparkwell.llm.text_stats import BASE, RATIOS, stats

#: Rows that learning takes at most, about: a uniform sample of the labelled rows outside the held-out fold.
FIT_ROWS = 6000
BUCKETS, RANK, THRESHOLD, PRIOR = 1 << 13, 8, 0.7, 0.5
METADATA = ["n_chars", "n_bytes", "n_lines", "n_blank_lines", "char_bytes"]
N_STATS = len(BASE) + len(RATIOS) + len(METADATA)
#: Of the statistics and metadata these are counts, or as skew as counts.
COUNTS = [i for i, n in enumerate(BASE + RATIOS + METADATA) if n.startswith("n_") or n in (*BASE, "words_per_line")]


class Words(dict):
    """Word to its bucket, kept for a bounded number of words."""

    def __missing__(self, word):
        import zlib

        if len(self) > 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word) % BUCKETS
        return found


def metadata(text: str | None) -> tuple:
    """The values of METADATA."""
    t = text or ""
    n, lines = len(t.encode()), t.split("\n") if t else []
    return len(t), n, len(lines), sum(not x.strip() for x in lines), n / max(len(t), 1)


def dense(rows: list) -> np.ndarray:
    """Statistics and metadata, as logarithms where they are counts."""
    x = np.array(rows, np.float64).reshape(-1, N_STATS)
    x[:, COUNTS] = np.log1p(x[:, COUNTS])
    return x


#: Features of some texts: dense ones (a row for each), and hashed words as (row, bucket, value), rows of length 1.
Features = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def features(texts: list, buckets: Words) -> Features:
    found, where, which, value = [], [], [], []
    for i, text in enumerate(texts):
        found.append((*stats(text), *metadata(text)))
        words = (text or "").encode().lower().split()
        if words:
            got, count = np.unique(np.fromiter((buckets[w] for w in words), np.int64, len(words)), return_counts=True)
            v = np.log1p(count)
            where.append(np.full(len(got), i))
            which.append(got)
            value.append(v / np.sqrt((v * v).sum()))
    joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((where, np.int64), (which, np.int64), (value, np.float64))]
    return dense(found), *joined


class Machine:
    """Parameters of the model; its size depends on BUCKETS and RANK alone."""

    def __init__(self, w0, w, v, mean, scale):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def terms(self, x, row, col, val):
        """Sparse and dense features as one list of (row, column, value), the statistics after the buckets."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        n = len(x)
        return n, np.concatenate([row, np.repeat(np.arange(n), N_STATS)]), np.concatenate([col, np.tile(np.arange(BUCKETS, BUCKETS + N_STATS), n)]), np.concatenate([val, z.ravel()])

    def sums(self, n, row, col, val):
        linear = np.bincount(row, self.w[col] * val, n)
        s = np.empty((n, RANK))
        q = np.empty((n, RANK))
        for f in range(RANK):
            t = self.v[col, f] * val
            s[:, f] = np.bincount(row, t, n)
            q[:, f] = np.bincount(row, t * t, n)
        return self.w0 + linear + 0.5 * (s * s - q).sum(1), s

    def score(self, texts: list, buckets: Words) -> np.ndarray:
        z, _ = self.sums(*self.terms(*features(texts, buckets)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(found: Features, labels: list, steps: int = 280, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine | None:
    """Adam over mini-batches of the log loss, at least `steps` of them and five passes; None without both classes."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    x, row, col, val = found
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(BUCKETS + N_STATS), rng.normal(0, 0.01, (BUCKETS + N_STATS, RANK)), x.mean(0), x.std(0) + 1e-6)
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in (("w", m.w), ("v", m.v))}
    step = 0
    for _ in range(max(5, -(-steps * 128 // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            pick = order[at : at + 128]
            take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            r = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
            n, r, c, v = m.terms(x[pick], r, col[take], val[take])
            z, s = m.sums(n, r, c, v)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            step += 1
            m.w0 -= rate * g.mean()
            gv = g[r] * v / len(pick)
            uniq, inv = np.unique(c, return_inverse=True)
            grads = {"w": np.bincount(inv, gv, len(uniq)) + decay * m.w[uniq], "v": np.empty((len(uniq), RANK))}
            for f in range(RANK):
                grads["v"][:, f] = np.bincount(inv, gv * (s[r, f] - m.v[c, f] * v), len(uniq))
            grads["v"] += decay * m.v[uniq]
            for k, p in (("w", m.w), ("v", m.v)):
                a, b = state[k]
                a[uniq] = 0.9 * a[uniq] + 0.1 * grads[k]
                b[uniq] = 0.99 * b[uniq] + 0.01 * grads[k] ** 2
                p[uniq] -= rate * (a[uniq] / (1 - 0.9**step)) / (np.sqrt(b[uniq] / (1 - 0.99**step)) + 1e-8)
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 11, id_col="doc_id", text_col="text") -> DataFrame:
    """(key, text, y): at most `rows` labelled texts (more only where hashes tie), drawn from the labelled rows outside the held-out fold.

    Labels are drawn first, at a rate that follows from their count, and then rows by id and text, so the bound holds
    however many rows have one id or repeat another.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).where("__id is not null and y in (0, 1)").where(~held_out("__id")).distinct()
    n = known.count()
    known = known.where(uniform(seed, "__id") < min(1.0, rows / max(n, 1)))
    picked = F.broadcast(known) if n else known  # about `rows`
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(picked, "__id").select(text_key("__id", "text").alias("key"), "text", "y")
    place = F.xxhash64("key", "y", F.lit(seed + 1))
    last = found.select(place.alias("p")).distinct().orderBy("p").limit(rows).agg(F.max("p")).first()[0]
    return found.where(place <= last if last is not None else F.lit(False)).groupBy("key", "y").agg(F.first("text").alias("text")).select("key", "text", "y")


def learn(docs: DataFrame, labels: DataFrame, **columns) -> Machine | None:
    """The tasks compute the features; the driver gets those of the sample, at most BUCKETS words of each text, and no text."""

    def run(batches):
        import pyarrow as pa

        buckets = Words()
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                x, row, col, val = features(part.column(1).to_pylist(), buckets)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c)) for c in (col, val)]
                wide = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), wide, *lists], ["key", "y", "x", "col", "val"])
        trim()

    found = labelled_sample(docs, labels, **columns).mapInArrow(run, "key long, y int, x array<double>, col array<long>, val array<double>").toArrow()
    found = found.sort_by([("key", "ascending"), ("y", "ascending")]).combine_chunks()
    if not found.num_rows:
        return None
    x, col, val = (found.column(c).combine_chunks() for c in ("x", "col", "val"))
    row = np.repeat(np.arange(found.num_rows), np.diff(col.offsets.to_numpy()))
    machine = fit((x.flatten().to_numpy().reshape(-1, N_STATS), row, col.flatten().to_numpy(), val.flatten().to_numpy()), found.column("y").to_pylist())
    del found, x, col, val, row
    trim()  # the driver goes on to other stages
    return machine


def scored(machine: Machine | None, texts: list, buckets: Words) -> np.ndarray:
    return np.full(len(texts), PRIOR) if machine is None else machine.score(texts, buckets)


def score_documents(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score at THRESHOLD or more)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        buckets = Words()
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scored(machine, part.column(1).to_pylist(), buckets))], ["doc_id", "score"])
        trim()

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns; all rows where there is no model."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        buckets = Words()
        for batch in batches:
            for part in slices(batch, at, 4 << 20):
                yield part.filter(pa.array(scored(machine, part.column(at).to_pylist(), buckets) >= THRESHOLD))
        trim()

    return docs if machine is None else docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
