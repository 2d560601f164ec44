"""Retrieval for whole DataFrames of queries: exact cosine, BM25, boosts, diversity, neighbours and scopes.

cosine_top_k, bm25_top_k and fields_top_k read the query set, and BM25 counts its terms, by jobs that run while the plan is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import ship
from sparkwell.functions.text import tokens

ship(__name__)

K1, B = 1.2, 0.75
#: Rows that meet a block of queries in one matrix product, words that such rows have unless one has more, and queries of such a block.
ROWS, WORDS, QUERIES = 256, 1 << 17, 512


def top_k(rows: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best rows of each query, with rank; scores that agree to nine digits tie."""
    order = Window.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The k best (query, key, id) that a task has seen: larger keys first, then smaller ids; kept in bounded arrays.

    k is one number, or an array with a number for each query.
    """

    def __init__(self, queries: int, k):
        import numpy as np

        self.queries, self.k, self.least, self.parts, self.held = queries, np.broadcast_to(np.asarray(k, np.int64), queries), np.full(queries, -np.inf), [], 0
        self.least[self.k <= 0] = np.inf

    def offer(self, scores, ids: list, above: float = -1.0) -> None:
        """scores: queries x rows; ids: arrays of the rows' id parts."""
        import numpy as np

        key = np.round(scores, 9)
        q, r = np.nonzero((key >= self.least[:, None]) & (scores > above))
        self.parts.append((q, key[q, r], scores[q, r], *(x[r] for x in ids)))
        self.held += len(q)
        if self.held > 2 * int(self.k.sum()) + 10_000:
            self.settle()

    def settle(self) -> tuple | None:
        """(queries, keys, scores, id parts...) of what is kept."""
        import numpy as np

        if not self.parts:
            return None
        q, key, score, *ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((*reversed(ids), -key, q))
        q, key, score, *ids = (x[order] for x in (q, key, score, *ids))
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k[q] - 1
        self.least[q[last]] = key[last]
        keep = nth < self.k[q]
        self.parts, self.held = [tuple(x[keep] for x in (q, key, score, *ids))], int(keep.sum())
        return self.parts[0]


def id_parts(column) -> list:
    """An Arrow column of ids as arrays that sort as Spark sorts them; for structs one for each field.

    Null integers stand before all others and come back as null; null strings count as empty.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_struct(column.type):
        return [part for f in column.flatten() for part in id_parts(f)]
    if pa.types.is_integer(column.type):
        return [pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)]
    return [np.array(pc.fill_null(column.cast(pa.string()), "").to_pylist(), dtype=str)]


def as_ids(parts: list, kind):
    """The inverse of id_parts for an Arrow type."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([as_ids([x], f.type) for x, f in zip(parts, kind)], names=[f.name for f in kind])
    if pa.types.is_integer(kind):
        return pa.array(parts[0], mask=parts[0] == np.iinfo(np.int64).min).cast(kind)
    return pa.array(parts[0].tolist(), pa.string()).cast(kind)


def found(best: Best, names: list, query_kind, id_kind):
    """Arrow batches (query_id, id, score) of what a task has kept."""
    import pyarrow as pa

    kept = best.settle()
    if kept is not None and len(kept[0]):
        q, _, score, *ids = kept
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], query_kind), as_ids(ids, id_kind), pa.array(score)], ["query_id", "id", "score"])


def schema_of(queries: DataFrame, rows: DataFrame) -> tuple:
    """(Spark schema, Arrow type of query_id, Arrow type of id) of hits."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DoubleType, StructField, StructType

    q, i = queries.schema["query_id"].dataType, rows.schema["id"].dataType
    return StructType([StructField("query_id", q), StructField("id", i), StructField("score", DoubleType())]), to_arrow_type(q), to_arrow_type(i)


def with_k(queries: DataFrame, k: int | str) -> DataFrame:
    """queries with __k: the number, or the column of that name, where null counts as 0."""
    return queries.withColumn("__k", F.coalesce(F.col(k).cast("int"), F.lit(0)) if isinstance(k, str) else F.lit(k))


def in_blocks(queries: DataFrame, columns: list[str], block: int):
    """The query set, which the caller states, as lists of about `block` rows (one empty list if it is empty)."""
    n = queries.count()
    parts = -(-n // block)
    if parts <= 1:
        yield queries.select(columns).collect()
    for part in range(parts if parts > 1 else 0):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select(columns).collect()


def all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int | str = 10, block: int = 16384) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, embedding) its k nearest of vectors (id, embedding), exactly.

    k may name a column of queries, so that each has a pool of its own size.

    The query set is stated by the caller and taken in blocks: each block is one pass over the vectors, a matrix product for
    every part of a batch and QUERIES queries, and each task keeps k rows of each query.  Scores are cosine + 1; null and zero vectors, and
    vectors of another width than the query's block, have a cosine of 0.
    """
    import numpy as np

    schema, query_kind, id_kind = schema_of(queries, vectors)
    out = []
    most = 0
    for rows in in_blocks(with_k(queries, k), ["query_id", "embedding", "__k"], block):
        names, given, sizes = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        most = max([most, *sizes])
        width = max((len(v) for v in given if v is not None), default=1)
        q = np.zeros((len(rows), width))
        for i, v in enumerate(given):
            if v is not None and len(v) == width and all(x is not None for x in v):
                q[i] = v
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches, unit=unit, names=names, sizes=sizes, width=width):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            best = [Best(min(QUERIES, len(names) - q), sizes[q : q + QUERIES]) for q in range(0, len(names), QUERIES)]
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    column = part.column(1)
                    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
                    x = np.zeros((part.num_rows, width))
                    x[fits] = pc.fill_null(column.filter(pa.array(fits)).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    ids = id_parts(part.column(0))
                    for i, own in enumerate(best):
                        own.offer(unit[i * QUERIES : (i + 1) * QUERIES] @ x.T + 1.0, ids)
                batch = part = column = None
            for i, own in enumerate(best):
                yield from found(own, names[i * QUERIES : (i + 1) * QUERIES], query_kind, id_kind)

        out.append(vectors.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, schema))
    return best_of(all_of(out), queries, k, most)


def best_of(hits: DataFrame, queries: DataFrame, k: int | str, most: int) -> DataFrame:
    """The k best of each query's hits; where k is a column, `most` is the largest."""
    if not isinstance(k, str):
        return top_k(hits, k)
    own = with_k(queries, k).select("query_id", "__k")
    return top_k(hits, most).join(own, "query_id").where("rank <= __k").drop("__k")


def parts_of(batch, lists: list[int], rows: int = ROWS, words: int = WORDS):
    """Slices of an Arrow batch of at most `rows` rows and, but for single rows, `words` entries in the list columns at `lists`.

    What a task makes of a slice is bounded so, however long the batch's texts are.
    """
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in lists))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + words, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def counts_of(words, terms):
    """(row, term, tf) of the terms that a list column of words has, and the lists' lengths."""
    import numpy as np
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    code, tf = np.unique(row[at >= 0] * max(len(terms), 1) + at[at >= 0], return_counts=True)
    return code // max(len(terms), 1), code % max(len(terms), 1), tf, n


def bm25_top_k(queries: DataFrame, docs: DataFrame, id_col: str, text: str, k: int | str, every: bool = False, k1: float = K1, b: float = B, block: int = 16384) -> DataFrame:
    """(query_id, id, score, rank): the k best of docs (id_col, text) for each query (query_id, text) by BM25.

    k may name a column of queries, so that each has a pool of its own size.  With `every`, only documents that have each term of the query.  No postings are shuffled and no pair of query and document leaves
    its task: one pass counts in how many documents each query term stands, a second scores parts of a batch against the query
    set, which the caller states and which is taken in blocks, by matrix products over the terms at hand, and keeps k rows
    of each query in each task.  A document that shares no term is no hit; null texts have no words but count as documents.
    """
    import numpy as np
    import pyarrow as pa

    words = docs.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    asked = with_k(queries, k).select("query_id", F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array().cast("array<string>")).alias("terms"), "__k")
    schema, query_kind, id_kind = schema_of(asked, words)
    out, most = [], 0
    for rows in in_blocks(asked, ["query_id", "terms", "__k"], block):
        names, sizes = [r[0] for r in rows], np.array([r[2] for r in rows], np.int64)
        most = max([most, *sizes.tolist()])
        place = {t: i for i, t in enumerate(sorted({t for r in rows for t in r[1]}))}
        terms = pa.array(list(place), pa.string())
        # which queries ask for a term, terms one after the other
        pairs = sorted((place[t], i) for i, r in enumerate(rows) for t in r[1])
        term_of, query_of = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
        size = np.array([len(r[1]) for r in rows], np.int64)

        def count(batches, terms=terms):
            import numpy as np

            held, total, length = np.zeros(len(terms), np.int64), 0, 0
            for batch in batches:
                for part in parts_of(batch, [0]):
                    _, term, _, n = counts_of(part.column(0), terms)
                    held += np.bincount(term, minlength=len(terms))
                    total, length = total + len(n), length + int(n.sum())
                batch = part = None  # not held while the next is read
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([total, length, *held[at].tolist()], pa.int64())], ["term", "n"])

        counted = dict(words.select("w").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row for each query term
        total = counted.get(-1, 0)
        average = (counted.get(-2, 0) / total if total else 0.0) or 1.0
        df = np.array([counted.get(i, 0) for i in range(len(terms))], float)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))

        def run(batches, terms=terms, names=names, sizes=sizes, term_of=term_of, query_of=query_of, size=size, idf=idf, average=average):
            import numpy as np

            best = [Best(min(QUERIES, len(names) - q), sizes[q : q + QUERIES]) for q in range(0, len(names), QUERIES)]
            block_of = query_of // QUERIES
            asks = [(term_of[block_of == i], query_of[block_of == i] % QUERIES) for i in range(len(best))]
            for batch in batches:
                for part in parts_of(batch, [1]):
                    row, term, tf, n = counts_of(part.column(1), terms)
                    if not len(row):
                        continue
                    here, col = np.unique(term, return_inverse=True)
                    weight = np.zeros((part.num_rows, len(here)))
                    weight[row, col] = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[row] / average))
                    ids = id_parts(part.column(0))
                    for i, own in enumerate(best):
                        t, q = asks[i]
                        c = np.searchsorted(here, t)
                        known = here[np.minimum(c, len(here) - 1)] == t
                        wants = np.zeros((len(here), own.queries))
                        wants[c[known], q[known]] = 1.0
                        score = (weight @ wants).T
                        if every:
                            score[((weight > 0) @ wants).T < size[i * QUERIES : i * QUERIES + own.queries, None]] = 0.0
                        own.offer(score, ids, 0.0)
                batch = part = None
            for i, own in enumerate(best):
                yield from found(own, names[i * QUERIES : (i + 1) * QUERIES], query_kind, id_kind)

        out.append(words.mapInArrow(run, schema))
    return best_of(all_of(out), queries, k, most)


def fields_top_k(queries: DataFrame, docs: DataFrame, id_col: str, fields: dict[str, float], k: int, total: bool = False, every: bool = False, k1: float = K1, b: float = B, block: int = 16384) -> DataFrame:
    """(query_id, id, score, rank): the k best of docs by several fields (text column: boost), each by BM25 with statistics of its own.

    A document scores its best field's boosted score, or with `total` the sum of all.  With `every`, each term of the query must stand in
    one field or another.  All fields are counted in one pass and scored in a second, by matrix products over the terms
    of one field after the other; null texts have no words.
    """
    import numpy as np
    import pyarrow as pa

    names_of, boosts = list(fields), list(fields.values())
    none = F.array().cast("array<string>")
    words = docs.select(F.col(id_col).alias("id"), *(F.coalesce(tokens(F.col(f)), none).alias(f"w{i}") for i, f in enumerate(names_of)))
    asked = queries.select("query_id", F.coalesce(F.array_distinct(tokens(F.col("text"))), none).alias("terms"))
    schema, query_kind, id_kind = schema_of(asked, words)
    out = []
    for rows in in_blocks(asked, ["query_id", "terms"], block):
        names = [r[0] for r in rows]
        place = {t: i for i, t in enumerate(sorted({t for r in rows for t in r[1]}))}
        terms = pa.array(list(place), pa.string())
        pairs = sorted((place[t], i) for i, r in enumerate(rows) for t in r[1])
        term_of, query_of = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
        size = np.array([len(r[1]) for r in rows], np.int64)

        def count(batches, terms=terms):
            import numpy as np

            held, total, length = np.zeros((len(names_of), len(terms)), np.int64), 0, np.zeros(len(names_of), np.int64)
            for batch in batches:
                for part in parts_of(batch, list(range(len(names_of)))):
                    for i in range(len(names_of)):
                        _, term, _, n = counts_of(part.column(i), terms)
                        held[i] += np.bincount(term, minlength=len(terms))
                        length[i] += int(n.sum())
                total += batch.num_rows
                batch = part = None
            field, at = np.nonzero(held)
            sums = [[0, *range(len(names_of)), *field.tolist()], [-1, *[-2] * len(names_of), *at.tolist()], [total, *length.tolist(), *held[field, at].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(sums[0], pa.int32()), pa.array(sums[1], pa.int64()), pa.array(sums[2], pa.int64())], ["field", "term", "n"])

        counted = {(r[0], r[1]): r[2] for r in words.drop("id").mapInArrow(count, "field int, term long, n long").groupBy("field", "term").agg(F.sum("n")).collect()}  # a row for each field and query term
        n_docs = counted.get((0, -1), 0)
        df = np.array([[counted.get((i, t), 0) for t in range(len(terms))] for i in range(len(names_of))], float).reshape(len(names_of), len(terms))
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        average = [(counted.get((i, -2), 0) / n_docs if n_docs else 0.0) or 1.0 for i in range(len(names_of))]

        def run(batches, terms=terms, names=names, term_of=term_of, query_of=query_of, size=size, idf=idf, average=average):
            import numpy as np

            best = [Best(min(QUERIES, len(names) - q), k) for q in range(0, len(names), QUERIES)]
            block_of = query_of // QUERIES
            asks = [(term_of[block_of == i], query_of[block_of == i] % QUERIES) for i in range(len(best))]
            for batch in batches:
                for part in parts_of(batch, list(range(1, len(names_of) + 1))):
                    counts = [counts_of(part.column(i + 1), terms) for i in range(len(names_of))]
                    here = np.unique(np.concatenate([f[1] for f in counts]))
                    if not len(here):
                        continue
                    weights, there = [], np.zeros((part.num_rows, len(here)))
                    for i, (row, term, tf, n) in enumerate(counts):
                        col = np.searchsorted(here, term)
                        weight = np.zeros((part.num_rows, len(here)))
                        weight[row, col] = boosts[i] * idf[i][term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[row] / average[i]))
                        there[row, col] = 1.0
                        weights.append(weight)
                    ids = id_parts(part.column(0))
                    for i, own in enumerate(best):
                        t, q = asks[i]
                        c = np.searchsorted(here, t)
                        known = here[np.minimum(c, len(here) - 1)] == t
                        wants = np.zeros((len(here), own.queries))
                        wants[c[known], q[known]] = 1.0
                        score = sum(w @ wants for w in weights) if total else np.max([w @ wants for w in weights], axis=0)
                        score = score.T
                        if every:
                            score[(there @ wants).T < size[i * QUERIES : i * QUERIES + own.queries, None]] = 0.0
                        own.offer(score, ids, 0.0)
                batch = part = None
            for i, own in enumerate(best):
                yield from found(own, names[i * QUERIES : (i + 1) * QUERIES], query_kind, id_kind)

        out.append(words.mapInArrow(run, schema))
    return top_k(all_of(out), k)


def best_field(scored: list[tuple[DataFrame, float]]) -> DataFrame:
    """(query_id, id, score): of several fields' boosted scores the largest."""
    parts = [df.select("query_id", "id", (F.col("score") * boost).alias("score")) for df, boost in scored]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def diversify(hits: DataFrame, k: int, per: int = 2, key: str = "doc_id", overflow: bool = True) -> DataFrame:
    """At most `per` hits of a key first, the others after them if overflow; k in all, renumbered as rank."""
    nth = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    rows = hits.withColumn("__late", (nth > per).cast("int"))
    if not overflow:
        rows = rows.where("__late = 0")
    order = Window.partitionBy("query_id").orderBy("__late", "rank")
    return rows.withColumn("__new", F.row_number().over(order)).where(F.col("__new") <= k).drop("rank", "__late").withColumnRenamed("__new", "rank")


def neighbours(hits: DataFrame, chunks: DataFrame, first: int = 2, reach: int = 1) -> DataFrame:
    """(query_id, doc_id, chunk_index, chunk): the best `first` hits' chunks and those up to `reach` beside them."""
    around = hits.where(F.col("rank") <= first).select("query_id", "doc_id", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index")).where("chunk_index >= 0").distinct()
    return around.join(chunks, ["doc_id", "chunk_index"]).select("query_id", "doc_id", "chunk_index", "chunk")
