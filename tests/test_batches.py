"""What a task makes of an Arrow batch is bounded, whatever the batch's texts; results don't depend on the parts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkwell.operators import chunking, embedding, retrieval


def peak(f):
    """(result, MB that Python and numpy had at most beside what was there before)."""
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_parts_of_a_batch():
    n = [3, 0, 500_000, None, 7, *[900] * 1000]
    words = pa.array([None if k is None else ["w"] * k for k in n], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(n))), words], ["id", "w"])
    parts = list(retrieval.parts_of(batch, [1]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(n)))
    for p in parts:
        assert p.num_rows == 1 or (p.num_rows <= retrieval.ROWS and sum(len(x or []) for x in p.column(1).to_pylist()) <= retrieval.WORDS)
    assert len(parts) < 20
    terms = pa.array(["v", "w"])
    tf, most = peak(lambda: sum(int(retrieval.counts_of(p.column(1), terms)[2].sum()) for p in retrieval.parts_of(batch.slice(5), [1])))
    assert tf == 900_000 and most < 20
    assert list(retrieval.parts_of(batch.slice(0, 0), [1])) == []


def test_counts_by_bucket():
    own = np.random.default_rng(1).integers(0, 8, (2000, 500)).astype(np.int32)
    lists = [None, [], *own.tolist()]
    x = pa.array(lists, pa.list_(pa.int32()))
    got, most = peak(lambda: embedding.counts_by_bucket(x, 8))
    assert got.to_pylist() == [np.bincount(r or [0], minlength=8).astype(float).tolist() if r else [0.0] * 8 for r in lists]
    assert most < 5


def test_serialised_arrays():
    ss = [[f"Sentence {i} of {j}." for i in range(j % 300)] for j in range(1500)]
    want = [chunking.serialised(f"t{j}", s, 512) for j, s in enumerate(ss)]
    titles, texts = pa.array([f"t{j}" for j in range(1500)]), pa.array(ss, pa.list_(pa.string()))
    got, most = peak(lambda: chunking.serialised_arrays(titles, texts, 512))
    assert got.to_pylist() == want and most < 5
    assert chunking.serialised_arrays(titles.slice(0, 0), texts.slice(0, 0), 512).to_pylist() == []
