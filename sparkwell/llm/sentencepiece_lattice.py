"""SentencePiece encoding and decoding of whole documents.

A text gets the dummy prefix and is cut into units where no piece can reach across: a unit is a run of spaces with the
letters, or the other characters, behind it.  U+2581 counts as a space; texts keep the space, and the pieces are read with
it, since strings of one byte a character are cut far faster.  The distinct units of a part of a batch each have a lattice: their
substrings that are pieces, found by a join with the piece table (a bounded vocabulary, held as a trie whose steps are looked up for
all places at once), plus an edge for each character that is no piece, which stands for its UTF-8 bytes.  Units of one length are folded
by Viterbi together, place by place; the ids of a document are those of its units.  Spark cuts the texts into units and deals the documents;
no document meets another, so nothing is shuffled.  Time and memory are linear in a unit's length.

The path has the largest sum of the pieces' scores; of equal sums the one whose last piece is shortest.  The model file in
use was made for merges in order, so paths differ from the merges' on part of the words (README has the share); decoding
is exact for both.  The query builds the ids of every document, decodes them, and compares the text that they give with its own.

Defined cases: a null or empty text has no pieces (null decodes to null, no pieces to the empty text); U+2581 decodes to a
space, so a text that holds it isn't given back; a null id stays null and repeated rows each get a row; ids that are no piece
or byte decode to nothing; very long texts are cut into units whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwell.llm.common import slices, table, trim

SPACE, VOCABULARY = "▁", "piece_bpe_32k.model"
#: Longer units are folded edge by edge, each by itself.
LONG = 256
#: Units that are folded at a time.
TOGETHER = 4096
UNIT = " *\\p{L}+| *[^ \\p{L}]+| +"


def piece_rows(path: str | None = None) -> tuple[list[tuple[str, int, float]], dict]:
    """(piece, id, score) of the ordinary pieces; and the facts that the lattice needs: longest, unknown, byte0."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    rows = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    return rows, {"longest": max(len(r[0]) for r in rows), "unknown": min(r[2] for r in rows if r[2] > -1e8) - 10.0, "byte0": m.piece_to_id("<0x00>")}


def piece_table(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, dict]:
    rows, facts = piece_rows(path)
    return spark.createDataFrame(rows, "piece string, id int, score double"), facts


def units(text: Column) -> Column:
    prepared = F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" ")))
    return F.when(F.length(text) > 0, F.regexp_extract_all(prepared, F.lit(UNIT), F.lit(0)))


NONE, ODD = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table as a trie: node 0 is the root; (node, character) leads to a node, which may be a piece's end.

    Steps stand in an open hash table of arrays under node * 2^21 + character, so those of many places are one lookup.
    """

    def __init__(self, rows: list[tuple[str, int, float]], facts: dict):
        steps, ends = {}, {}
        for piece, i, score in rows:
            node = 0
            for c in piece.replace(SPACE, " "):
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = max(ends.get(node, (score, i)), (score, i))
        self.longest, self.unknown, self.byte0 = facts["longest"], facts["unknown"], facts["byte0"]
        self.id, self.score = np.full(len(steps) + 1, -1, np.int32), np.full(len(steps) + 1, -np.inf)
        for node, (score, i) in ends.items():
            self.id[node], self.score[node] = i, score
        bits = (4 * len(steps)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, NONE), np.zeros(1 << bits, np.int32)
        keys = np.fromiter(steps, np.uint64, len(steps))
        for at, k, to in zip(((keys * ODD) >> self.shift).tolist(), keys, steps.values()):
            while self.keys[at] != NONE:
                at = (at + 1) & self.mask
            self.keys[at], self.to[at] = k, to

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where the characters lead from the nodes, 0 for nowhere."""
        keys = node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64)
        at = ((keys * ODD) >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], 0)
        more = np.flatnonzero((held != keys) & (held != NONE))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            held = self.keys[at[more]]
            out[more] = np.where(held == keys[more], self.to[at[more]], 0)
            more = more[(held != keys[more]) & (held != NONE)]
        return out

    def lattice(self, chars: np.ndarray):
        """(length, places, nodes) of the pieces in units of one length; chars has a row for each place and a column for each unit, places count row by row."""
        size, width = chars.shape
        flat = chars.ravel()
        at, node = np.arange(flat.size), np.zeros(flat.size, np.int32)
        for n in range(1, min(self.longest, size) + 1):
            room = int(np.searchsorted(at, (size - n + 1) * width))
            at = at[:room]
            node = self.step(node[:room], flat[at + (n - 1) * width])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                return
            whole = self.id[node] >= 0
            yield n, at[whole], node[whole]

    def paths(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids one unit after the other) of the best paths of units of one length; -1 - c for a character c that is no piece."""
        size, width = chars.shape
        score, ids = {}, {}
        for n, at, node in [(1, np.zeros(0, np.int64), np.zeros(0, np.int32)), *self.lattice(chars)]:
            score[n], ids[n] = np.full((size, width), self.unknown if n == 1 else -np.inf), (-1 - chars if n == 1 else np.zeros((size, width), np.int32))
            score[n].ravel()[at], ids[n].ravel()[at] = self.score[node], self.id[node]
        best, back = np.zeros((size + 1, width)), np.ones((size + 1, width), np.int32)
        for stop in range(1, size + 1):
            best[stop] = -np.inf
            for n in sorted((n for n in score if n <= stop), reverse=True):  # of equal sums the shorter piece
                now = best[stop - n] + score[n][stop - n]
                better = now >= best[stop]
                np.copyto(best[stop], now, where=better)
                np.copyto(back[stop], n, where=better)
        out, count = np.zeros((width, size), np.int32), np.zeros(width, np.int64)
        unit, stop = np.arange(width), np.full(width, size)
        known = np.zeros((self.longest + 1, size, width), np.int32)
        for n in ids:
            known[n] = ids[n]
        while len(unit):
            n = back[stop, unit]
            stop = stop - n
            count[unit] += 1
            out[unit, size - count[unit]] = known[n, stop, unit]
            unit, stop = unit[stop > 0], stop[stop > 0]
        return count, out[np.arange(size) >= (size - count)[:, None]]

    def path(self, chars: np.ndarray) -> np.ndarray:
        """The same for one long unit, edge by edge."""
        size = len(chars)
        found = list(self.lattice(chars.reshape(-1, 1)))
        start = np.concatenate([np.zeros(0, np.int64), *(at for _, at, _ in found)])
        stop = np.concatenate([np.zeros(0, np.int64), *(at + n for n, at, _ in found)])
        node = np.concatenate([np.zeros(0, np.int32), *(x for *_, x in found)])
        single = np.setdiff1d(np.arange(size), start[stop == start + 1])
        score, ids = np.concatenate([self.score[node], np.full(len(single), self.unknown)]), np.concatenate([self.id[node], -1 - chars[single]])
        start, stop = np.concatenate([start, single]), np.concatenate([stop, single + 1])
        order = np.lexsort((start, stop))
        best, back = [0.0] + [float("-inf")] * size, [(0, 0)] * (size + 1)
        for a, b, s, i in zip(start[order].tolist(), stop[order].tolist(), score[order].tolist(), ids[order].tolist()):
            if best[a] + s >= best[b]:
                best[b], back[b] = best[a] + s, (a, i)
        out, at = [], size
        while at:
            at, i = back[at]
            out.append(i)
        return np.array(out[::-1], np.int32)

    def encode(self, names) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of an Arrow array of units: each with the ids of its best path."""
        import pyarrow.compute as pc

        size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le", "surrogatepass"), np.int32)
        begin = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        counts, parts = [], []
        for a, b in zip(cuts, cuts[1:]):
            n = int(size[order[a]])
            for c in range(a, b, 1 if n > LONG else TOGETHER):
                own = order[c : min(c + TOGETHER, b)]
                if n > LONG:
                    ids = self.path(chars[begin[own[0]] : begin[own[0]] + n])
                    count = np.array([len(ids)])
                else:
                    count, ids = self.paths(chars[begin[own] + np.arange(n)[:, None]])
                ids, per = self.spelt_out(ids)
                total = np.concatenate([[0], np.cumsum(per)])
                ends = np.cumsum(count)
                counts.append(total[ends] - total[ends - count])
                parts.append(ids)
        count, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (counts, parts))
        # back in the order of the names
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = (np.cumsum(count) - count)[place]
        count = count[place]
        offsets = np.concatenate([[0], np.cumsum(count)])
        return offsets, ids[np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])]

    def spelt_out(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the UTF-8 bytes of a character c in place of -1 - c, and how many stand for each."""
        c = -1 - ids.astype(np.int64)
        per = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        if (ids >= 0).all():
            return ids, per
        at = np.repeat(np.arange(len(ids)), per)
        nth = np.arange(len(at)) - (np.cumsum(per) - per)[at]
        c, n = c[at], per[at]
        byte = np.where(nth > 0, c >> 6 * (n - 1 - nth) & 63 | 128, c >> 6 * (n - 1) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n])
        return np.where(c < 0, ids[at], byte + self.byte0).astype(np.int32), per


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, parts: the ids of each of the text's units, none for a text without any."""
    pieces = Pieces(*piece_rows(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), units(F.col(text_col).cast("string")).alias("units"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, 1):
                words = part.column(2)
                flat = words.flatten().dictionary_encode()
                offsets, ids = pieces.encode(flat.dictionary)
                each = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())).take(flat.indices)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each)], ["doc_id", "text", "parts"])
            batch = part = words = flat = each = None  # not held while the next is read
        trim()

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *StructType.fromDDL("parts array<array<int>>").fields]))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids."""
    return coded(docs, id_col, text_col, path).select("doc_id", F.when(F.col("text").isNotNull(), F.flatten("parts")).alias("ids"))


def spelt(rows: DataFrame, ids: str, path: str | None = None) -> DataFrame:
    """rows with `bytes`: those that the ids of each row stand for one after the other, U+2581 as a space."""
    own, facts = piece_rows(path)
    of = {i: piece.replace(SPACE, " ").encode() for piece, i, _ in own} | {facts["byte0"] + b: bytes([b]) for b in range(256)}
    last = max(of) + 1  # stands for ids that are none
    at, spelling = rows.columns.index(ids), [of.get(i, b"") for i in range(last + 1)]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = pa.array(spelling, pa.binary())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lists = part.column(at)
                flat = pc.fill_null(lists.flatten(), last).to_numpy(zero_copy_only=False)
                bytes_ = pieces.take(pa.array(np.where((flat < 0) | (flat > last), last, flat)))
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                # what follows each other is one value from the first one's beginning to the last one's end
                cuts = np.frombuffer(bytes_.buffers()[1], np.int32, len(bytes_) + 1)[ends] if len(bytes_) else np.zeros(len(ends), np.int32)
                whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(cuts)), bytes_.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*part.columns, whole], [*part.schema.names, "bytes"])
            batch = part = lists = None
        trim()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("bytes binary").fields]))


def plain(bytes_: Column) -> Column:
    """The text that bytes give; the dummy prefix goes."""
    return F.substr(F.decode(bytes_, "UTF-8"), F.lit(2))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row of encoded: doc_id, text."""
    rows = spelt(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), "ids", path)
    return rows.select("doc_id", F.when(F.col("ids").isNotNull(), plain(F.col("bytes"))).alias("text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its pieces' number, a checksum of places and ids, and whether decoding its ids gives its own text back."""
    rows = coded(table(spark, sf_dir, "documents"))
    # the ids of a unit and its place, whatever unit they are of
    each = F.transform("parts", lambda ids, at: F.shiftrightunsigned(F.xxhash64(at, F.xxhash64(ids)), 28))
    checksum = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    back = spelt(rows.select("doc_id", "text", checksum.alias("ids_checksum"), F.flatten("parts").alias("ids")), "ids")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_checksum", F.coalesce(plain(F.col("bytes")) == F.col("text"), F.lit(True)).alias("decoded"))
