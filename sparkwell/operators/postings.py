"""An inverted index as a table: blocks of postings by (range of documents, term), each with bounds of what it can add to a score.

The index is a folder of segments.  A segment is what one `add` wrote, usually a micro-batch: `docs` has a row for each document
(its range and length), `blocks` a row for each range with the blocks of its terms, sorted by term.  Bounds stand in columns of their
own, so that what can't reach the best k is ruled out before any postings are read.  A range is scored where it lies: no
posting and no pair of query and document is shuffled.

A search is for queries that are few beside the documents: it has a row for each query and range that share a term, and tasks know
the query set's terms.  Query sets of many thousands are better served by `retrieval.bm25_top_k`, which passes over the documents once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkwell import ship
from sparkwell.functions.text import tokens
from sparkwell.operators.retrieval import K1, QUERIES, B, Best, all_of, found, id_parts, schema_of, top_k
from sparkwell.storage import written

ship(__name__)

#: Documents of a range: fewer give closer bounds and more blocks.
RANGE = 64
#: Ranges that a search scores for each query before it rules others out.
PROBE = 4


def impact(tf, length, average: Column | float, k1: float = K1, b: float = B):
    """What a posting adds to a score but for the term's weight; it grows with tf and falls with length (columns or arrays)."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, length, terms, tfs): the distinct words of each text, sorted, and how often each stands in it; a null text has none."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("length int, terms array<string>, tfs array<int>").fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = part.column(1)
                length = words.value_lengths().to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                names = coded.dictionary
                order = np.argsort(np.array(names.to_pylist(), dtype=object)) if len(names) else np.zeros(0, np.int64)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row = np.repeat(np.arange(part.num_rows), length)
                code, tf = np.unique(row * max(len(order), 1) + place[coded.indices.to_numpy()], return_counts=True)
                row, code = code // max(len(order), 1), code % max(len(order), 1)
                cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(cuts, names.take(pa.array(order[code])))
                tfs = pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32()), terms, tfs], schema.names)

    words = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("id"), words.alias("w")).mapInArrow(run, schema)


def inverted(ranges: DataFrame) -> DataFrame:
    """(range, ids, lengths, terms, n, most, least, rows, tfs) of ranges (range, ids, lengths, held, words, counts), whose documents have `held` words each.

    A term's postings are n of the rows (places in ids) and tfs, one term after the other.
    """
    names = ["range", "ids", "lengths", "terms", "n", "most", "least", "rows", "tfs"]
    schema = T.StructType([*ranges.select(*names[:3]).schema.fields, *T.StructType.fromDDL("terms array<string>, n array<int>, most array<int>, least array<int>, rows array<int>, tfs array<int>").fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        numbers = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32()))
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                length, held, tf = (one.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 5))
                coded = one.column(4).flatten().dictionary_encode()
                order = np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object)) if len(coded.dictionary) else np.zeros(0, np.int64)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row, code = np.repeat(np.arange(len(held)), held), place[coded.indices.to_numpy()]
                by = np.lexsort((row, code))
                row, code, tf = row[by], code[by], tf[by]
                first = np.searchsorted(code, np.arange(len(order)))
                most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length[row], first)) if len(first) else (first, first)
                terms = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], terms, *map(numbers, (np.diff(first, append=len(code)), most, least, row, tf))], names)
            batch = one = None

    return ranges.mapInArrow(run, schema)


@dataclass
class Index:
    """An index in the folder at path.  A segment that is written again replaces itself, so a repeated batch changes nothing."""

    spark: SparkSession
    path: str
    size: int = RANGE

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = 0, order: tuple[str, ...] = ()) -> None:
        """Indexes docs as one segment.  With `order`, ranges have documents that are near each other by these columns.

        Documents are written first: a segment counts as there once its blocks are, which are written last.
        """
        if order:
            docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
        self.write(self.numbered(counted(docs, id_col, text_col)), "docs", segment)
        self.add_blocks(segment)

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows with doc, and the range that it falls in: documents that one task reads one after the other."""
        row = F.expr(f"(doc & {(1 << 33) - 1}) div {self.size}")
        return rows.withColumn("doc", F.monotonically_increasing_id()).withColumn("range", F.shiftright("doc", 33) * (1 << 33) + row)

    def add_blocks(self, segment: int) -> None:
        own = self.spark.read.parquet(f"{self.path}/docs").where(F.col("segment") == segment)
        # a range's documents, with their words, are put together: no more than `size` of them
        whole = own.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("doc", "id", "length", "terms", "tfs"))).alias("d"))
        ranges = whole.select("range", F.col("d.id").alias("ids"), F.col("d.length").alias("lengths"), F.transform("d.terms", F.size).alias("held"), F.flatten("d.terms").alias("words"), F.flatten("d.tfs").alias("counts"))
        self.write(inverted(ranges), "blocks", segment)

    def write(self, rows: DataFrame, name: str, segment: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/segment={segment}")

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        return self.stored("blocks")

    def heads(self) -> DataFrame:
        """(segment, range, term, n, most, least): the blocks without their postings."""
        each = F.arrays_zip("terms", "n", "most", "least")
        return self.blocks().select("segment", "range", F.explode(each).alias("h")).select("segment", "range", F.col("h.terms").alias("term"), "h.n", "h.most", "h.least")

    def docs(self) -> DataFrame:
        """The documents of finished segments."""
        done = [r.segment for r in self.blocks().select("segment").distinct().collect()]  # one for each segment
        return self.stored("docs").where(F.col("segment").isin(done))

    def compact(self, target: str) -> Index:
        """All segments as one, in the folder at target, without going back to the texts."""
        out = Index(self.spark, target, self.size)
        out.write(out.numbered(self.docs().drop("segment", "doc", "range")), "docs", 0)
        out.add_blocks(0)
        return out

    def asked(self, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
        """((query_id, term, k, idf), average length) for queries (query_id, text) that may have their own k."""
        totals = self.docs().agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
        n, average = totals.n, (totals.l or 0) / totals.n if totals.n and totals.l else 1.0
        own = F.coalesce(F.col("k").cast("int"), F.lit(k)) if "k" in queries.columns else F.lit(k)
        # Written, so that its size is known where the join is planned: small ones are sent to the blocks.
        terms = written(queries.select("query_id", own.alias("k"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "postings-asked")
        held = self.heads().select("term", "n").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(held, "term").select("query_id", "term", "k", idf.alias("idf")), average

    def bounds(self, terms: DataFrame, average: float) -> DataFrame:
        """(query_id, k, segment, range, bound, blocks): what no document of a range can exceed."""
        most = F.col("idf") * impact(F.col("most"), F.col("least"), average)
        return self.heads().join(terms, "term").groupBy("query_id", "segment", "range").agg(F.first("k").alias("k"), F.sum(most).alias("bound"), F.count("*").alias("blocks"))

    def scored(self, terms: DataFrame, wanted: DataFrame, average: float) -> DataFrame:
        """(query_id, id, score, k): the k best documents of each query that a task finds in the ranges of wanted (query_id, segment, range)."""
        import numpy as np
        import pyarrow as pa

        blocks = self.blocks()
        schema, query_kind, id_kind = schema_of(terms, blocks.select(F.col("ids")[0].alias("id")))
        idf = {r.term: r.idf for r in terms.select("term", "idf").distinct().collect()}  # the query set's terms
        asked = terms.groupBy("query_id").agg(F.first("k").alias("k"), F.collect_list("term").alias("terms")).collect()
        place = {t: i for i, t in enumerate(sorted(idf))}
        known, weights = pa.array(list(place), pa.string()), np.array([idf[t] for t in place], float)
        out = []
        for at in range(0, max(len(asked), 1), QUERIES):
            some = asked[at : at + QUERIES]
            names, sizes = [r.query_id for r in some], np.array([r.k for r in some], np.int64)
            pairs = sorted((place[t], i) for i, r in enumerate(some) for t in r.terms)
            term_of, query_of = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))

            def run(batches, names=names, sizes=sizes, term_of=term_of, query_of=query_of):
                import numpy as np
                import pyarrow as pa
                import pyarrow.compute as pc

                best, own = Best(len(names), sizes), pa.array(names, query_kind)
                for batch in batches:
                    for at in range(batch.num_rows):
                        asks, ids, length, words, n, row, tf = (c.flatten() for c in batch.slice(at, 1).columns)
                        length, n, row, tf = (x.to_numpy(zero_copy_only=False) for x in (length, n, row, tf))
                        asks = pc.fill_null(pc.index_in(asks, value_set=own), -1).to_numpy(zero_copy_only=False)
                        asks = asks[asks >= 0]
                        code = np.repeat(pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False), n)
                        row, tf, code = row[code >= 0], tf[code >= 0], code[code >= 0]
                        if not len(asks) or not len(code):
                            continue
                        here, col = np.unique(code, return_inverse=True)
                        weight = np.zeros((len(length), len(here)))
                        weight[row, col] = weights[code] * impact(tf, length[row], average)
                        c = np.minimum(np.searchsorted(here, term_of), len(here) - 1)
                        held = here[c] == term_of
                        wants = np.zeros((len(here), len(names)))
                        wants[c[held], query_of[held]] = 1.0
                        score = np.zeros((len(names), len(length)))
                        score[asks] = (weight @ wants[:, asks]).T
                        best.offer(score, id_parts(ids), 0.0)
                    batch = None
                yield from found(best, names, query_kind, id_kind)

            per = wanted.groupBy("segment", "range").agg(F.collect_list("query_id").alias("asks"))
            rows = blocks.join(per, ["segment", "range"]).select("asks", "ids", "lengths", "terms", "n", "rows", "tfs")
            out.append(rows.mapInArrow(run, schema))
        return all_of(out).join(F.broadcast(terms.groupBy("query_id").agg(F.first("k").alias("k"))), "query_id")  # a row for each query

    def waves(self, queries: DataFrame, k: int = 10, probe: int = PROBE) -> tuple[DataFrame, DataFrame]:
        """(hits before the last choice, bounds with `wave`: 1 scored first, 2 scored then, null ruled out).

        The first wave scores each query's ranges of the largest bounds; the score of its k-th document is what others must reach.
        """
        terms, average = self.asked(queries, k)
        terms = written(terms, "postings-terms")
        bounds = written(self.bounds(terms, average), "postings-bounds")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range"))
        first = written(bounds.withColumn("nth", nth).where(F.col("nth") <= probe).drop("nth"), "postings-probe")
        hits = written(self.scored(terms, first, average), "postings-hits")
        ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        reach = ranked.where(F.col("nth") == F.col("k")).select("query_id", F.col("score").alias("reach"))
        mark = first.select(F.col("query_id").alias("q"), F.col("segment").alias("s"), F.col("range").alias("r"), F.lit(1).alias("seen"))
        same = (F.col("query_id") == F.col("q")) & (F.col("segment") == F.col("s")) & (F.col("range") == F.col("r"))
        judged = bounds.join(reach, "query_id", "left").join(mark, same, "left")
        # Sums of other orders differ in their last digits.
        wave = F.when(F.col("seen").isNotNull(), 1).when(F.col("reach").isNull() | (F.col("bound") >= F.col("reach") - 1e-6), 2)
        judged = written(judged.select("query_id", "segment", "range", "blocks", wave.alias("wave")), "postings-judged")
        return hits.unionByName(self.scored(terms, judged.where("wave = 2"), average)), judged

    def search(self, queries: DataFrame, k: int = 10, probe: int = PROBE) -> DataFrame:
        """(query_id, id, score, rank): the k best documents of each query, exactly as BM25 ranks them."""
        hits, _ = self.waves(queries, k, probe)
        most = k if "k" not in queries.columns else queries.agg(F.max(F.coalesce(F.col("k").cast("int"), F.lit(k)))).first()[0] or k
        ranked = top_k(hits.select("query_id", "id", "score", "k"), most)
        return ranked.where(F.col("rank") <= F.col("k")).select("query_id", "id", "score", "rank")


def index_stream(docs: DataFrame, path: str, checkpoint: str, size: int = RANGE, **trigger) -> StreamingQuery:
    """Starts a query that indexes a stream of (doc_id, text): a micro-batch is a segment, and one that comes again replaces itself."""
    spark = docs.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        Index(spark, path, size).add(rows, segment=number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
