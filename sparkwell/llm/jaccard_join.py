"""N-gram Jaccard join by PartEnum signatures: an exact similarity self-join of shingle sets, and its components.

Sets fall into size bands so narrow that similar sets lie in one band or in neighbouring ones.  Instance j of the
scheme holds bands j-1 and j; similar sets in it differ in at most k elements.  Their domain is hashed into n1 parts of
n2 subparts each, with (k2 + 1) * n1 > k: some part then has at most k2 differing elements, hence n2 - k2 subparts that
agree, and each choice of n2 - k2 subparts of each part is a signature.  So similar sets always share a signature.

1. One pass over the texts gives each document its set's size, 64-bit digest and odd sketch: a bit for each hash
   value, set if an odd number of elements have it.  Equal sets share a digest and are one node.
2. A second pass gives signatures (once per digest and task), which are sorted in partitions.  Digests that share
   one are a group; groups with the same members count once.
3. Two sets' sketches differ in no more bits than the sets differ in elements.  Pairs of a group that this bound doesn't
   rule out are joined; components are families, and no link leaves a family.
4. One document of each digest in a family gives its set.  Families are cut into blocks of BLOCK sets.  A block, and
   later a pair of blocks, is a unit of work that counts intersections by an inverted index and emits a spanning forest of
   the links it finds.  Only the components of links are asked for, so no pairs are listed, and sets which one
   component holds already needn't meet.
5. Components of the links, and the smallest id in each.

Groups and units are searched from set to set: a set is held against those that nothing has reached yet, so a cluster
of which one set is like all others costs one round over them, not one for each pair.

Defined cases: a null, empty or all-white text has the empty set, which links with nothing (its component is its own
id); texts of fewer words than a shingle have their whole word sequence as the one shingle; a null id is ignored when
ids are compared (and stays null if it is alone); repeated rows each get a row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell.llm.common import M1, WordHashes, free_prefix, mix, row_key, slices, table, trim, written
from sparkwell.llm.components import Forest, components

#: Production parameters: words to a shingle, and the least similarity as a ratio of integers.
WORDS, NUM, DEN = 3, 9, 10
#: Sets to a block of a family, and sets of a family that meet all its blocks before others do.
BLOCK, HUBS = 256, 8
#: (n2, k2): the more selective, the more signatures.  The first that keeps chance groups under CHANCE sets is taken.
SCHEMES, CHANCE = [(3, 1), (5, 2), (7, 3), (9, 4)], 2000


def scheme(sets: int, num: int, den: int) -> tuple[int, int]:
    """Of SCHEMES for so many sets: sets without any element in a signature's subparts share it by chance."""
    for n2, k2 in SCHEMES:
        elements = (n2 - k2) / n2 * (k2 + 1) * (den + num) / (2.2 * (den - num))
        if sets / 10 * np.exp(-elements) <= CHANCE:
            break
    return n2, k2


def shingles(texts: list, hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, joined, and their number in each text."""
    words, count = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            got = [hashes[w] for w in t.encode().lower().split()]
            count[i] = len(got)
            words.append(np.array(got, np.uint64))
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    ends = np.cumsum(count)
    out, size = [], np.zeros(len(texts), np.int64)
    n = max(len(flat) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * M1 + flat[k : k + n])
    for i, (end, c) in enumerate(zip(ends.tolist(), count.tolist())):
        if c >= width:
            u = np.unique(rolled[end - c : end - width + 1])
        elif c:
            h = np.uint64(c)
            for x in flat[end - c : end]:
                h = mix(np.array([h], np.uint64) * M1 + x)[0]
            u = np.array([h], np.uint64)
        else:
            continue
        out.append(u)
        size[i] = len(u)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), size


def bands(most: int, num: int, den: int) -> np.ndarray:
    """The largest size of each band up to one that holds `most`: band 0 holds size 0, band 1 starts at size 1."""
    top = [0]
    while top[-1] < most:
        low = top[-1] + 1
        top.append(max(low, low * den // num))
    return np.array(top, np.int64)


def digests(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each set: an order-free sum over its scrambled elements, mixed with its size."""
    sums = np.zeros(len(size), np.uint64)
    np.add.at(sums, np.repeat(np.arange(len(size)), size), mix(flat + M1))
    return mix(sums + mix(size.astype(np.uint64)))


def sketches(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's odd sketch, of a power of two of 64-bit words, at least 1.5 bits to an element: unrelated sets then differ in far more bits than links may."""
    words = 1 << np.ceil(np.log2(np.maximum(1.5 * size / 64, 1))).astype(np.int64)
    base = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    h = mix(flat + M1 + M1)
    np.bitwise_xor.at(out, base[owner] + ((h >> np.uint64(6)).astype(np.int64) & (words[owner] - 1)), np.uint64(1) << (h & np.uint64(63)))
    return [out[a : a + n].tobytes() for a, n in zip(base.tolist(), words.tolist())]


def signatures(flat: np.ndarray, size: np.ndarray, num: int, den: int, n2: int = 3, k2: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All sets' signatures, joined set by set, and their number for each set."""
    tops = bands(int(size.max(initial=1)) * den // num + 2, num, den)
    band = np.searchsorted(tops, size)
    owner = np.repeat(np.arange(len(size)), size)
    found, whose = [], []
    where, what = mix(flat ^ M1), mix(flat + np.uint64(0x5851F42D4C957F2D))
    for step in (0, 1):
        j = np.minimum(band + step, len(tops) - 1)
        k = 2 * tops[j] * (den - num) // (den + num)  # |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)
        n1 = np.where((k > 0) & (size > 0), k // (k2 + 1) + 1, 0)  # k = 0: only equal sets, which share a digest
        base = np.cumsum(n1) - n1
        live = n1[owner] > 0
        own = owner[live]
        sub = n2 * base[own] + (where[live] % (n2 * n1[own]).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(n2 * int(n1.sum()), np.uint64)
        np.add.at(sums, sub, what[live])
        s = sums.reshape(-1, n2)
        doc = np.repeat(np.arange(len(size)), n1)
        part = np.arange(len(doc)) - base[doc]
        label = mix((j[doc].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64) * np.uint64(1024))
        for nth, chosen in enumerate(combinations(range(n2), n2 - k2)):
            sig = label + np.uint64(nth)
            for c in chosen:
                sig = mix(sig * M1 + s[:, c])
            found.append(sig)
            whose.append(doc)
    sig, doc = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(doc, kind="stable")
    return sig[order], np.bincount(doc, minlength=len(size))


def described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, k1, k2, n, g, sketch) for each row of docs: k1 and k2 are 128 bits of its id and text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 3, 2 << 20):
                flat, size = shingles(part.column(3).to_pylist(), hashes, width)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size), pa.array(digests(flat, size).view(np.int64)), pa.array(sketches(flat, size), pa.binary())], ["id", "k1", "k2", "n", "g", "sketch"])
        trim()

    texts = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col, ["k1", "k2"]), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, k1 long, k2 long, n long, g long, sketch binary")


def signed(docs: DataFrame, text_col: str, width: int, num: int, den: int, n2: int, k2: int) -> DataFrame:
    """(g, sigs), once for each digest that a task meets."""

    def run(batches):
        import pyarrow as pa

        hashes, sent = WordHashes(), set()
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                flat, size = shingles(part.column(0).to_pylist(), hashes, width)
                g = digests(flat, size)
                if len(sent) > 500_000:
                    sent.clear()
                new = np.array([not (x in sent or sent.add(x)) for x in g.tolist()], bool) & (size > 0)
                if new.any():
                    sig, n = signatures(flat[np.repeat(new, size)], size[new], num, den, n2, k2)
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.view(np.int64)))], ["g", "sigs"])
        trim()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "g long, sigs array<long>")


def groups(rows: DataFrame) -> DataFrame:
    """(s, g): the digests that share a signature; s stands for their set, so that equal groups are one."""

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        last, held, total, base = None, [], 0, 0  # the signature that may go on, and its digests so far

        def push(g):
            """Keeps digests of the open signature; copies go now and then, so a hot one costs linear time and its own size."""
            nonlocal held, total, base
            held.append(np.unique(g))
            total += len(held[-1])
            if total > 2 * base + 100_000:
                held = [np.unique(np.concatenate(held))]
                total = base = len(held[0])

        def flush():
            g = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            return out(np.full(len(g), last, np.int64), g) if len(g) > 1 else None

        def out(s, g):
            if not len(s):
                return None
            pairs = np.unique(np.stack([s, g], 1), axis=0)
            s, g = pairs[:, 0], pairs[:, 1]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.append(first, len(s)))
            h = mix(g.view(np.uint64))
            key = mix(np.add.reduceat(h, first) + n.astype(np.uint64))
            if len(seen) > 1_000_000:
                seen.clear()
            new = np.array([c > 1 and not (k in seen or seen.add(k)) for k, c in zip(key.tolist(), n.tolist())], bool)
            keep = np.repeat(new, n)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)[keep].view(np.int64)), pa.array(g[keep])], ["s", "g"]) if keep.any() else None

        for batch in batches:
            if not batch.num_rows:
                continue
            s, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = int(np.searchsorted(s, last, "right")) if last is not None else 0
            if start:
                push(g[:start])
            if start == len(s):
                continue
            if (b := flush()) is not None:
                yield b
            cut = int(np.searchsorted(s, s[-1]))  # the last signature may go on
            last, held, total, base = int(s[-1]), [], 0, 0
            push(g[cut:])
            twice = s[start:cut]
            same = np.concatenate([[False], twice[1:] == twice[:-1]])
            multi = same | np.concatenate([same[1:], [False]]) if len(twice) else same[:0]
            if (b := out(twice[multi], g[start:cut][multi])) is not None:
                yield b
        if (b := flush()) is not None:
            yield b

    dealt = rows.select(F.explode("sigs").alias("s"), "g").repartition("s").sortWithinPartitions("s")
    return dealt.mapInArrow(run, "s long, g long")


def family_edges(members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of groups (s, g, n, sketch): a spanning forest of the pairs that sketches don't rule out."""

    def plausible(n, sketch):
        m = len(n)
        if m < 4:
            for i in range(1, m):
                for j in range(i):
                    a, b = sketch[i], sketch[j]
                    low = min(len(a), len(b))
                    x, y = (int.from_bytes(np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, low // 8), axis=0).tobytes() if len(z) > low else z, "little") for z in (a, b))
                    if (x ^ y).bit_count() * (den + num) <= (den - num) * (n[i] + n[j]):
                        yield i, j
            return
        low = min(map(len, sketch)) // 8
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, low), axis=0) for z in sketch])
        n = np.array(n)

        def near(i, rest):
            for a in range(0, len(rest), 4096):
                some = rest[a : a + 4096]
                far = np.bitwise_count(rows[some] ^ rows[i]).sum(1, dtype=np.int64)
                yield some[far * (den + num) <= (den - num) * (n[i] + n[some])]

        yield from spanning(m, lambda i, rest: np.concatenate(list(near(i, rest))))

    def run(batches):
        import pyarrow as pa

        forest, key, held = Forest(), None, {}

        def edges():
            g, n, sketch = list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]
            return [(g[i], g[j]) for i, j in plausible(n, sketch) if forest.joins(g[i], g[j])]

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])

        for batch in batches:
            for s, g, n, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if s != key:
                    if pairs := edges():
                        yield batch_of(pairs)
                    key, held = s, {}
                held[g] = n, sketch
        if pairs := edges():
            yield batch_of(pairs)

    return members.repartition("s").sortWithinPartitions("s").mapInArrow(run, "u long, v long")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(f, g, set): for each wanted (id, g, f) the set of one document with that id and digest."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 2):
                flat, size = shingles(part.column(2).to_pylist(), hashes, width)
                same = digests(flat, size).view(np.int64) == part.column(1).to_numpy()
                cut = np.split(flat, np.cumsum(size)[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() if ok else None for x, ok in zip(cut, same)], pa.binary())], ["f", "g", "set"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"])).select("f", "g", "text")
    return rows.mapInArrow(run, "f long, g long, set binary").where("set is not null")


def spanning(m: int, near):
    """Edges (i, j) of a spanning forest of 0 .. m - 1; near(i, rest): those of the array rest that i is related to."""
    rest, reached = np.arange(m), []
    while len(rest):
        if reached:
            i = reached.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        if len(rest):
            hit = near(i, rest)
            if len(hit):
                rest = rest[~np.isin(rest, hit)]
                for j in hit.tolist():
                    reached.append(j)
                    yield i, j


def links_in(sets: list[np.ndarray], num: int, den: int):
    """Edges (i, j) of a spanning forest of similar sets, by counting common elements through an inverted index."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    start = np.concatenate([[True], np.diff(flat[order]) != 0])
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(flat)))
    posting = owner[order]
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(start) - 1
    ends = np.cumsum(size)

    def near(i, rest):
        e = which[ends[i] - size[i] : ends[i]]
        e = e[length[e] > 1]
        if not len(e):
            return rest[:0]
        n = length[e]
        at = np.repeat(first[e] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        common = np.bincount(posting[at], minlength=m)[rest]
        return rest[den * common >= num * (size[i] + size[rest] - common)]

    yield from spanning(m, near)


def link_edges(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): a spanning forest of the links within each (f, a, b), rows of which come together."""

    def run(batches):
        import pyarrow as pa

        key, g, sets, sent = None, [], [], {}

        def found():
            forest, out = Forest(), {}
            for i, j in links_in(sets, num, den) if len(sets) > 1 else ():
                if g[i] != g[j] and forest.joins(g[i], g[j]):
                    out[g[i], g[j]] = True
            return list(out)

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for f, a, b, x, s in zip(*cols):
                if (f, a, b) != key:
                    if pairs := found():
                        yield batch_of(pairs)
                    key, g, sets = (f, a, b), [], []
                g.append(x)
                sets.append(np.frombuffer(s, np.uint64))
        if pairs := found():
            yield batch_of(pairs)

    return blocks.repartition("f", "a", "b").sortWithinPartitions("f", "a", "b").mapInArrow(run, "u long, v long")


def family_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): edges whose components are those of the links within the families (f, g, set).

    Each block is searched by itself.  A family of several blocks goes on: its HUBS sets with most edges so far meet
    every block, as clusters of near copies have an original that all are like.  Then sets outside the family's largest
    component (rest) meet all blocks; pairs within that component are joined already and meet nowhere.  With h and r blocks
    of the two, (2 h + r) r pairs of blocks are left of (h + r) squared.
    """
    size = sets.groupBy("f").agg(F.count("*").alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = sets.join(size, "f").withColumn("b", F.pmod(F.xxhash64("g"), F.col("nb")).cast("int")).withColumn("a", F.lit(-1))
    own = written(link_edges(rows.select("f", "a", "b", "g", "set"), num, den), "links")
    if size.where("nb > 1").isEmpty():
        return own
    large = written(rows.where("nb > 1"), "large")
    degree = own.select(F.explode(F.array("u", "v")).alias("g")).groupBy("g").count()
    rank = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("count"), "g"))
    hubs = large.select("f", "g").join(degree, "g").withColumn("at", rank).where(F.col("at") <= HUBS).select("g")
    hubs = large.join(hubs, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    out = own.unionByName(written(link_edges(large.unionByName(hubs.select(*large.columns)).select("f", "a", "b", "g", "set"), num, den), "links"))

    joined = components(out.join(large.select(F.col("g").alias("u")), "u", "left_semi"))
    named = large.select("f", "g", "set").join(joined.withColumnRenamed("node", "g"), "g", "left").withColumn("label", F.coalesce("label", "g"))
    parts = named.groupBy("f", "label").agg(F.count("*").alias("m")).groupBy("f")
    parts = parts.agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("h"), F.sum("m").alias("m")).where("m > h")
    parts = parts.select("f", "top", F.ceil(F.col("h") / BLOCK).cast("int").alias("h"), F.ceil((F.col("m") - F.col("h")) / BLOCK).cast("int").alias("r"))
    left = written(named.join(parts, "f"), "left")
    rest = F.col("label") != F.col("top")
    mine = F.when(rest, F.col("h") + F.pmod(F.xxhash64("g"), F.col("r"))).otherwise(F.pmod(F.xxhash64("g"), F.col("h"))).cast("int")
    other = F.explode(F.sequence(F.when(rest, F.lit(0)).otherwise(F.col("h")), F.col("h") + F.col("r") - 1))
    pairs = left.withColumn("mine", mine).withColumn("other", other)
    pairs = pairs.select("f", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "g", "set")
    return out.unionByName(link_edges(pairs, num, den))


def classified(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows as `described` gives them, written; and (g, id, label) of each digest: its smallest id, and its component's name."""
    rows = written(described(docs, id_col, text_col, width), "sets")
    classes = rows.where("n > 0").groupBy("g").agg(F.min("id").alias("id"))
    n2, k2 = scheme(classes.count(), num, den)
    shared = written(groups(signed(docs, text_col, width, num, den, n2, k2)), "groups")
    known = rows.where("n > 0").join(shared.select("g").distinct(), "g", "left_semi").select("g", "n", "sketch").dropDuplicates(["g"])
    families = components(family_edges(shared.join(known, "g").select("s", "g", "n", "sketch"), num, den))
    wanted = families.select(F.col("node").alias("g"), F.col("label").alias("f")).join(classes, "g").checkpoint()
    sets = written(sets_of(docs, wanted, id_col, text_col, width).dropDuplicates(["g"]), "families")
    links = components(family_links(sets, num, den))
    return rows, classes.join(links.withColumnRenamed("node", "g"), "g", "left").withColumn("label", F.coalesce("label", "g"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; similar is |A & B| / |A | B| >= num / den."""
    rows, named = classified(docs, id_col, text_col, width, num, den)
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = named.join(least, "label").select(F.col("g").alias("__g"), "component_id")
    out = rows.where("n > 0").join(of, F.col("g") == F.col("__g"), "left").select("id", "n", "component_id")
    # texts without words all have one digest: they link with nothing and stay out of the join
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component of links, the one with the smallest id; a null id comes after all others.

    Rows without words link with nothing and stay.  Of rows with the same id and text one stays, whichever.  Of texts that share an id
    each counts for itself.
    """
    rows, named = classified(docs, id_col, text_col, width, num, den)
    own = rows.where("n > 0").groupBy("k1", "k2", "g").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
    own = own.join(named.select("g", "label"), "g").select("label", "k1", "k2", "copies", F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2").alias("at"))
    best = own.groupBy("label").agg(F.min("at").alias("best"))
    told = written(own.join(best, "label").select("k1", "k2", "copies", (F.col("at") == F.col("best")).alias("stays")), "verdicts")
    prefix = free_prefix(docs.columns)
    names = [prefix + "1", prefix + "2"]

    def keys(of):
        return of.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))

    kept = docs.select("*", *row_key(id_col, text_col, names)).join(keys(told.where("not stays")), names, "left_anti")
    again = told.where("stays and copies > 1")
    if not again.isEmpty():
        kept = kept.join(keys(again), names, "left_anti").unionByName(kept.join(keys(again), names, "left_semi").dropDuplicates(names))
    return kept.select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
