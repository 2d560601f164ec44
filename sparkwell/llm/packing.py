"""Best-fit packing of token sequences, shrunk first by Martello and Toth's dominance reduction.

Only a piece's length matters to packing, so the instance is the histogram of lengths: at most `capacity` counts at
any corpus size.  It is packed on the driver in runs: a run says that the pieces of one length with ranks r0 .. r1 - 1
take the sequences s0, s0 + 1, ... (`per` pieces each) from one offset on.

1. Texts become token ids; longer ones are cut into pieces; pieces are written with their rank among the pieces of
   their length in their task.
2. Counts by (task, length) give each task its first rank of each length.
3. Reduction: a set of at most three lengths that provably dominates all other sets with its longest length is fixed as a
   sequence, as often as counts allow.  Best fit, longest first, packs what remains.
4. Each piece finds its run by rank.

Defined cases: a null or empty text is the end token alone; very long texts are read whole and cut; a null id stays
null; repeated rows are packed each for itself; other columns are ignored; an empty table packs to no rows.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from types import ModuleType

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import slices, table, trim, written

CAPACITY, END_TOKEN, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Tasks to a block when their pieces are counted.
TASKS = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, each distinct stem tokenized once.

    A tokenizer of RULES never joins what ASCII white space parts, so a text's ids are those of its words, in order.  A word
    is a stem and the punctuation of ENDS behind it, where the tokenizer parts the two; `apart` asks it so for each last
    character of a stem.  Stems of ASCII are kept in lower case, as the tokenizer has them, but for what may hold an
    added token, which is met in its own spelling alone.  Stems are kept until there are `most`.  Texts go to a tokenizer
    of other rules whole.
    """

    #: A word of its own between others, of one id that no text without this character can have.
    MARK, AT_ONCE = "\x01", 500
    #: Longer runs of punctuation stay with their word.
    ENDS, LONGEST_END = ",.!?;:", 6
    #: The pre-tokens of the tokenizers that this holds for: none has white space.
    RULES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 600_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        rules = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        added = [x for x in rules["added_tokens"] if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or not x["content"].startswith("<|")]
        alone = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else -1
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [self.RULES] and not added and self.mark >= 0
        self.parted: dict[str, bool] = {}
        self.clear()

    def clear(self):
        self.stems: dict[str, int] = {"": 0}
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, last: str) -> bool:
        """Whether the tokenizer parts this character from punctuation behind it."""
        if last not in self.parted:

            def pre(text):
                return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

            self.parted[last] = bool(last) and pre(last + ".") == pre(last) + pre(".")
        return self.parted[last]

    def learn(self, stems: list[str]):
        """Numbers and ids for stems that are new."""
        some = [stems[a : a + self.AT_ONCE] for a in range(0, len(stems), self.AT_ONCE)]
        found, sizes = [], []
        for part, ids in zip(some, self.batch([f" {self.MARK} ".join(x) for x in some])):
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(part) - 1 and not any(self.MARK in w for w in part):
                found.append(np.delete(ids, cuts))
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                each = self.batch(part)
                found += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        new = np.concatenate(sizes)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(new) - new)
        self.size = np.append(self.size, new)
        self.ids = np.concatenate([self.ids, *found])
        self.stems.update(zip(stems, range(len(self.stems), len(self.stems) + len(stems))))

    def numbers(self, stems) -> np.ndarray:
        """The numbers of an Arrow array of distinct stems."""
        values = stems.to_pylist()
        if new := [x for x in values if x not in self.stems]:
            self.learn(new)
        return np.fromiter(map(self.stems.__getitem__, values), np.int64, len(values))

    def halves(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words (an Arrow array): the numbers of the stems and of the punctuation behind them, 0 for none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        stem = pc.ascii_rtrim(words, characters=self.ENDS)
        n = pc.subtract(pc.binary_length(words), pc.binary_length(stem)).to_numpy(zero_copy_only=False)
        last = pc.dictionary_encode(pc.utf8_slice_codeunits(stem, -1))
        parted = np.array([self.apart(x) for x in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        n = np.where(parted & (n <= self.LONGEST_END), n, 0)
        stem = pc.if_else(pa.array(n > 0), stem, words)
        plain = pc.and_(pc.string_is_ascii(stem), pc.invert(pc.match_substring(stem, "<|")))
        stem = pc.dictionary_encode(pc.if_else(plain, pc.ascii_lower(stem), stem))
        ends = np.zeros(len(words), np.int64)
        for k in np.unique(n[n > 0]).tolist():
            here = n == k
            end = pc.dictionary_encode(pc.utf8_slice_codeunits(words.filter(pa.array(here)), -k))
            ends[here] = self.numbers(end.dictionary)[end.indices.to_numpy()]
        return self.numbers(stem.dictionary)[stem.indices.to_numpy()], ends

    def encode(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (texts: an Arrow array of strings), each with `end` behind it, joined, and their number for each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = [np.append(x, np.uint32(end)) for x in self.batch(texts.to_pylist())]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if len(self.stems) > self.most:
            self.clear()
        # white space at either end of a text gives empty words, which have no ids
        lists = pc.ascii_split_whitespace(texts)
        code = pc.dictionary_encode(lists.flatten())
        a, b = self.halves(code.dictionary)
        size = self.size[a] + self.size[b]
        parts = np.stack([a, b], 1).ravel()
        n = self.size[parts]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = np.append(self.ids[np.repeat(self.start[parts] - at[:-1], n) + np.arange(at[-1])], np.uint32(end))
        words = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size), [len(ids)]])), pa.array(ids, pa.uint32()))
        stops = np.cumsum(pc.list_value_length(lists).to_numpy())
        codes = np.insert(code.indices.to_numpy(), stops, len(size))
        total = np.cumsum(np.append(size, 1)[codes])
        ends = total[stops + np.arange(len(stops))]
        return words.take(pa.array(codes)).flatten().to_numpy(), np.diff(np.concatenate([[0], ends]))


def encoder(path: str) -> Encoder:
    """The Python worker's own encoder for this vocabulary: what it has learned serves the worker's later tasks."""
    kept = sys.modules.setdefault("_sparkwell_encoders", ModuleType("_sparkwell_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): rank counts the task's pieces of the same length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, task, ranks = encoder(path).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                flat, sizes = encode(part.column(1), END_TOKEN)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = (np.cumsum(length) - length).tolist()
                data = memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at, length.tolist())]
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                rank = np.empty(len(order), np.int64)
                rank[order] = ranks[length[order]] + nth
                ranks += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


class Runs:
    """Runs of pieces: (length, first rank, number, first sequence, pieces in each sequence, offset of the first)."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.sequences, self.rows = 0, []
        self.sizes = sorted(counts)

    def take(self, length: int, sequence: int, times: int, per: int, offset: int, number: int | None = None):
        number = times * per if number is None else number
        self.rows.append((length, self.rank[length], number, sequence, per, offset))
        self.rank[length] += number
        self.left[length] -= number
        if not self.left[length]:
            del self.sizes[bisect_left(self.sizes, length)]

    def fix(self, lengths: list[int], times: int):
        """`times` sequences of just these lengths."""
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            self.take(length, self.sequences, times, per, offset)
            offset += per * length
        self.sequences += times

    def most(self, limit: int, without: tuple = ()) -> int | None:
        """The largest length of at most `limit` of which a piece is left beside those of `without`."""
        k = bisect_right(self.sizes, limit) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.count(self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else None


def least_sum(runs: Runs, n: int, without: int) -> int | None:
    """The sum of the n smallest pieces beside one of length `without`; None if there are fewer."""
    total = 0
    for s in runs.sizes:
        have = min(n, runs.left[s] - (s == without))
        total, n = total + have * s, n - have
        if not n:
            return total
    return None


def times(runs: Runs, lengths: list[int]) -> int:
    return min(runs.left[s] // lengths.count(s) for s in set(lengths))


def reduce(runs: Runs, capacity: int) -> int:
    """Fixes sequences that dominate all others with the same longest piece; returns how many."""
    before, changed = runs.sequences, True
    while changed:
        changed = False
        for j in reversed(runs.sizes[:]):
            while runs.left.get(j):
                room = capacity - j
                k = runs.most(room, (j,))
                if k is None:  # nothing fits beside j
                    runs.fix([j], runs.left[j] if room < j else 1)
                    changed = True
                    continue
                if j + k == capacity:  # whatever shares a sequence with j fits into k's place
                    runs.fix([j, k], times(runs, [j, k]))
                    changed = True
                    continue
                two = least_sum(runs, 2, j)
                if two is None or two > room:  # one piece at most fits beside j, and k is the largest
                    runs.fix([j, k], times(runs, [j, k]) if two is None or 2 * runs.sizes[0] > room else 1)
                    changed = True
                    continue
                three = least_sum(runs, 3, j)
                b = runs.most(room - k, (j, k))
                second = runs.most(room // 2, (j,))
                if (three is None or three > room) and b is not None and second is not None and b >= second:
                    # two at most fit: the larger of any two is at most k, the smaller at most half the room, so at most b
                    runs.fix([j, k, b], times(runs, [j, k, b]) if 3 * runs.sizes[0] > room else 1)
                    changed = True
                    continue
                break
    return runs.sequences - before


def best_fit(runs: Runs, capacity: int) -> None:
    """Longest pieces first, each into the fullest sequence with room; intervals of like sequences move as one."""
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, first: int, n: int):
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for s in reversed(runs.sizes[:]):
        while runs.left[s]:
            have, k = runs.left[s], bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, first, n = capacity, runs.sequences, -(-have // (capacity // s))
                runs.sequences += n
            per = room // s
            full = min(n, have // per)
            if full:
                runs.take(s, first, full, per, capacity - room)
                put(room - per * s, first, full)
            if full < n:
                rest = have - full * per
                if 0 < rest < per:
                    runs.take(s, first + full, 1, rest, capacity - room, rest)
                    put(room - rest * s, first + full, 1)
                    full += 1
                put(room, first + full, n - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int, int]:
    """(runs, sequences, sequences that the reduction fixed) for {length: number of pieces}."""
    runs = Runs({int(k): int(v) for k, v in counts.items() if v})
    fixed = reduce(runs, capacity)
    best_fit(runs, capacity)
    return runs.rows, runs.sequences, fixed


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    n = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        n[k] = v
    s = np.arange(capacity + 1)
    best = -(-int((n * s).sum()) // capacity)
    for a in range(capacity // 2 + 1):
        big, mid, small = s > capacity - a, (s <= capacity - a) & (s > capacity // 2), (s <= capacity // 2) & (s >= a)
        n2 = int(n[mid].sum())
        need = int((n * s)[small].sum()) - (n2 * capacity - int((n * s)[mid].sum()))
        best = max(best, int(n[big].sum()) + n2 + max(0, -(-need // capacity)))
    return best


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(pieces_of(docs, id_col, text_col, capacity, path or vocabulary_path()), "pieces")
    by_task = pieces.groupBy("length", "task").agg((F.max("rank") + 1).alias("n")).checkpoint()
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity)[0])
    # Runs follow from the histogram, so their number is bounded by the capacity, whatever the corpus.
    at = {}
    for length, rank, number, sequence, per, offset in runs:
        at.setdefault(length, []).append((rank, sequence, per, offset))
    at = {k: np.array(v, np.int64).T for k, v in at.items()}
    from pyspark.sql import Window

    def before(*keys):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # in two steps, so that no window holds more than a block of tasks, or all blocks, of one length
    by_task = by_task.withColumn("block", F.expr(f"task div {TASKS}"))
    blocks = by_task.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", before("length", "block").alias("base"))
    within = by_task.select("length", "block", "task", before("length", "block", "task").alias("before"))
    first = within.join(blocks, ["length", "block"]).select("length", "task", (F.col("before") + F.col("base")).alias("before"))
    ranked = pieces.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                here = length == s
                first, seq, per, off = at[int(s)]
                k = np.searchsorted(first, rank[here], "right") - 1
                nth = rank[here] - first[k]
                sequence[here], offset[here] = seq[k] + nth // per[k], off[k] + nth % per[k] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
