"""Hashed embeddings: counts of words by the hash of the word.  They stand in for a model's vectors, which aren't at hand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwell import ship
from sparkwell.functions.text import sentences, tokens

ship(__name__)

DIMS = 64
#: Rows that are counted at a time.
ROWS = 128


def buckets(text: Column, dims: int = DIMS) -> Column:
    """The bucket of each word; null for a null text."""
    return F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dims)


def counts_by_bucket(x: pa.Array, dims: int) -> pa.Array:
    """For each list of buckets how often each stands in it; some rows at a time, as words' places take several times the lists' own bytes."""
    import pyarrow.compute as pc

    counts = np.zeros(len(x) * dims)
    for first in range(0, len(x), ROWS):
        some = x.slice(first, ROWS)
        n = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(n), dtype=np.int32), n) * dims + some.flatten().to_numpy(zero_copy_only=False)
        counts[first * dims : (first + len(n)) * dims] = np.bincount(at, minlength=len(n) * dims)
    return pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, dims, dtype=np.int32), counts)


def hashed_vector(text: Column, dims: int = DIMS) -> Column:
    """Counts by bucket, over Arrow batches; zeros for texts without words and for null."""

    def run(x: pa.Array) -> pa.Array:
        return counts_by_bucket(x, dims)

    return F.arrow_udf(run, "array<double>")(buckets(text, dims))


def best_sentence(query: Column, text: Column, first: int, spare: int = 0, dims: int = DIMS) -> Column:
    """The largest cosine of the query with one of a text's first sentences; null without sentences.

    With `spare`, a text without sentences counts by its first `spare` characters.
    """
    own = F.slice(sentences(F.coalesce(text, F.lit(""))), 1, first)
    if spare:
        own = F.when(F.size(own) > 0, own).otherwise(F.array(F.substring(F.coalesce(text, F.lit("")), 1, spare)))

    def run(q: pa.Array, ss: pa.Array) -> pa.Array:
        out = []
        for a, parts in zip(q.to_pylist(), ss.to_pylist()):
            x = np.bincount(np.array(a or [], np.int64), minlength=dims).astype(float)
            ys = [np.bincount(np.array(p, np.int64), minlength=dims).astype(float) for p in parts or []]
            out.append(max((float(x @ y / max(np.sqrt((x @ x) * (y @ y)), 1e-300)) for y in ys), default=None))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(buckets(query, dims), F.transform(own, lambda s: buckets(s, dims)))
