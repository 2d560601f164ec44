"""An entity graph as DataFrames: mentions, frequencies, communities, matching and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell import ship
from sparkwell.functions.text import let, strip
from sparkwell.operators.retrieval import Best, all_of, found, top_k
from sparkwell.storage import ensure_checkpoints, written

ship(__name__)

MOST = 16
# The words that names and queries of a graph leave out.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]
#: The group of documents and entities that name nothing.
MISC = "misc"


def normalised(name: Column) -> Column:
    """ASCII words of a name in lower case without stop words."""
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(STOPWORDS)), " ")


def query_terms(text: Column) -> Column:
    """Distinct words of three characters or more that a query of the graph matches by."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS)))


# A word's edge, with letters and digits of any script; before a letter it is that no such character stands in front.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
BEGIN = r"(?<![\p{L}\p{N}_])"
WORD = r"[A-Z][A-Za-z0-9'&.-]+"


def names(title: Column, text: Column) -> Column:
    """A document's title and runs of up to four capitalised words of three characters or more, by first appearance; null counts as empty."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{BEGIN}{WORD}(?:\s+{WORD}){{0,3}}{EDGE}"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(F.array(strip(F.coalesce(title, F.lit("")))), runs), lambda x: F.length(x) >= 3))


def every_entity(title: Column, text: Column) -> Column:
    """The normalised forms of all names of a document, by first appearance."""
    return F.array_distinct(F.filter(F.transform(names(title, text), normalised), lambda e: e != ""))


def entities(title: Column, text: Column, most: int = MOST) -> Column:
    """(entity, name) of a document: its first `most` entities; of names with the same normalised form the first stands."""
    first = lambda forms, n: F.slice(F.array_distinct(F.filter(forms, lambda e: e != "")), 1, n)
    named = lambda own, forms: F.transform(first(forms, most), lambda e: F.struct(e.alias("entity"), F.get(own, F.array_position(forms, e).cast("int") - 1).alias("name")))
    return let(names(title, text), lambda own: let(F.transform(own, normalised), lambda forms: named(own, forms)))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "source") -> DataFrame:
    """(doc_id, place, entity, name)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(entities(F.col(title_col), F.col(text_col))).alias("place", "e"))
    return rows.select("doc_id", "place", "e.entity", "e.name")


def all_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "source") -> DataFrame:
    """(doc_id, place, entity) of every entity of a document, however many there are."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(every_entity(F.col(title_col), F.col(text_col))).alias("place", "entity"))


def group_key(entity: Column) -> Column:
    """The first word of an entity."""
    return F.split(entity, " ")[0]


def document_groups(docs: DataFrame, m: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, community): the group that most of a document's entities have, of equal ones the first named; MISC without entities."""
    n = m.select("doc_id", "place", group_key(F.col("entity")).alias("community")).groupBy("doc_id", "community").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    best = n.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "place", "community")).alias("b")).select("doc_id", "b.community")
    return docs.select(F.col(id_col).alias("doc_id")).distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("community", F.lit(MISC)).alias("community"))


def community_table(groups: DataFrame, m: DataFrame, titles: DataFrame, most: int = 6) -> DataFrame:
    """(community, size, summary) of groups (doc_id, community): how many documents, and the entities and first titles (doc_id, title) that they name."""
    size = groups.groupBy("community").agg(F.count("*").alias("size"))
    named = community_entities(m, groups, "community", most).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("e"))
    first = Window.partitionBy("community").orderBy("doc_id")
    pages = groups.join(titles, "doc_id").withColumn("n", F.row_number().over(first)).where("n <= 4").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("t"))
    four = F.array_join(F.transform(F.slice("e", 1, 4), lambda x: x["entity"]), ", ")
    topics = F.when(F.size("e") > 0, four).otherwise("linked topics")
    text = F.concat(F.lit("Community "), "community", F.lit(" centers on "), topics, F.lit(". Representative pages: "), F.array_join(F.transform("t", lambda x: x["title"]), ", "), F.lit("."))
    return size.join(named, "community", "left").join(pages, "community").select("community", "size", text.alias("summary"))


def frequencies(m: DataFrame) -> DataFrame:
    """(entity, freq): documents that mention it."""
    return m.groupBy("entity").agg(F.countDistinct("doc_id").alias("freq"))


def community_scores(matched: DataFrame, named: DataFrame, communities: DataFrame, boost: Column, limit: int) -> DataFrame:
    """(query_id, community, score, rank): matched entities that a community names (community, entity), plus a tenth of its size, times boost.

    boost may read columns of matched.
    """
    n = matched.withColumn("__b", boost).join(named.select("community", "entity"), "entity").groupBy("query_id", "community").agg(F.countDistinct("entity").alias("o"), F.first("__b").alias("b"))
    rows = n.join(communities.select("community", "size"), "community").select("query_id", "community", (F.col("b") * (F.col("o") + 0.1 * F.col("size"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.desc("community"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def routed_documents(matched: DataFrame, terms: DataFrame, m: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) by mentions (doc_id, entity, rank): 0.75 and the document's rank for each entity that it has of a matched group, 1.5 for each matched entity.

    A group is matched by a term of the query (query_id, terms) or by a matched entity's first word; each group counts once.
    """
    asked = terms.select("query_id", F.explode("terms").alias("group")).unionByName(matched.select("query_id", group_key(F.col("entity")).alias("group"))).distinct()
    own = m.select("doc_id", "entity", "rank", group_key(F.col("entity")).alias("group")).distinct()
    by_group = own.join(asked, "group").select("query_id", "doc_id", (0.75 + F.col("rank")).alias("w"))
    by_entity = matched.select("query_id", "entity").join(own.drop("rank"), "entity").select("query_id", "doc_id", F.lit(1.5).alias("w"))
    return by_group.unionByName(by_entity).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a graph's tables."""
    return all_of([df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in sorted(tables.items())])


def community_entities(m: DataFrame, docs: DataFrame, group: str = "source", most: int = 6) -> DataFrame:
    """(group, entity, docs, rank): the most mentioned entities of each group of documents."""
    n = m.join(docs.select("doc_id", group), "doc_id").groupBy(group, "entity").agg(F.countDistinct("doc_id").alias("docs"))
    order = Window.partitionBy(group).orderBy(F.desc("docs"), "entity")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def match_entities(queries: DataFrame, freq: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, entity, overlap, rank) for queries (query_id, terms): by shared words, then frequency, then name, all descending."""
    words = freq.select("entity", "freq", F.explode(F.array_distinct(F.split("entity", " "))).alias("t"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("t"))
    n = asked.join(words, "t").groupBy("query_id", "entity", "freq").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("freq"), F.desc("entity"))
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "entity", "overlap", "rank")


def seeded_documents(matched: DataFrame, m: DataFrame, pagerank: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): for each document the sum of 1 + its rank over the query's entities that it mentions."""
    rows = matched.join(m, "entity")
    if pagerank is None:
        return rows.groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    ranked = rows.join(pagerank.select(F.col("node").alias("doc_id"), F.col("rank").alias("__r")), "doc_id", "left")
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(1 + F.coalesce("__r", F.lit(0.0))).alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int = 50, least: float = 1e-6, part: int = 4096) -> DataFrame:
    """(node, rank) of nodes (node) and directed edges (src, dst, weight).

    seeds (node, weight) personalises; negative weights count as none.  What dangling nodes hold goes to the base
    distribution, so ranks sum to 1.  Ends when ranks move by less than `least` in sum.

    Nodes are dealt into parts of about `part`, and a part's edges are dealt once and kept where they lie.  A round is one shuffle: a part sends
    each other one number for every node that its edges lead to there, and what it holds for dangling nodes and how far it moved.
    Every ten rounds are written, which ends the lineage.
    """
    n = nodes.select("node").distinct()
    count = n.count()
    parts = max(1, -(-count // part))
    if seeds is None:
        base = n.withColumn("b", F.lit(1.0 / max(count, 1)))
    else:
        s = seeds.select("node", F.greatest("weight", F.lit(0.0)).alias("w"))
        total = s.agg(F.sum("w")).first()[0] or 1.0
        base = n.join(s, "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) / total).alias("b"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("t"), F.lit(True).alias("leads"))
    placed = base.join(out, "node", "left").withColumn("p", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("node")) - 1)
    placed = written(placed.select("node", "p", "i", "b", "t", (F.col("leads").isNull() & F.col("node").isNotNull()).alias("sink")), "rank-nodes")
    at = lambda c, *more: placed.select(F.col("node").alias(c), F.col("p").alias(f"{c}_p"), F.col("i").alias(f"{c}_i"), *more)
    led = edges.join(at("src", "t"), "src").join(at("dst"), "dst").select("src_p", "src_i", "dst_p", "dst_i", F.coalesce(F.col("weight") / F.col("t"), F.lit(0.0)).alias("w"))
    return ranked(placed, written(led, "rank-edges"), parts, alpha, rounds, least)


def unpacked(batches):
    """(p, i, rank) of parts and their ranks."""
    import numpy as np
    import pyarrow as pa

    for x in batches:
        for p, rank in zip(x.column("p").to_pylist(), x.column("rank").to_pylist()):
            r = np.frombuffer(rank, np.float64)
            yield pa.RecordBatch.from_pydict({"p": pa.array(np.full(len(r), p, np.int32)), "i": pa.array(np.arange(len(r), dtype=np.int32)), "rank": pa.array(r)})


def ranked(placed: DataFrame, led: DataFrame, parts: int, alpha: float, rounds: int, least: float) -> DataFrame:
    """(node, rank) of nodes (node, p, i, b, sink), each at place i of its part p, and edges (src_p, src_i, dst_p, dst_i, w)."""

    def packed(rows):
        """A part's edges in order of where they lead, and where those to the same node begin."""
        import numpy as np
        import pyarrow as pa

        src, to, dst, w = (rows.column(c).to_numpy() for c in ("src_i", "dst_p", "dst_i", "w"))
        order = np.lexsort((dst, to))
        first = np.flatnonzero(np.diff(to[order], prepend=-1) | np.diff(dst[order], prepend=-1))
        lists = {"src": src[order], "w": w[order], "first": first, "sent": np.bincount(to[order][first], minlength=parts)}
        return pa.table({"p": rows.column("src_p").slice(0, 1)} | {c: pa.array([x]) for c, x in lists.items()})

    own = placed.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "b", "sink"))).alias("own")).select("p", "own.b", "own.sink")
    sends = led.groupBy("src_p").applyInArrow(packed, "p int, src array<int>, w array<double>, first array<long>, sent array<long>")
    came = led.groupBy(F.col("dst_p").alias("p"), "src_p").agg(F.array_sort(F.collect_set("dst_i")).alias("at")).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("src_p", "at"))).alias("came"))
    kept = own.join(sends, "p", "left").join(came.select("p", F.flatten("came.at").alias("at")), "p", "left").repartition(parts, "p").persist()
    kept.count()  # before rounds are planned: how parts lie is known once they do
    kind = "p int, f int, v binary, rank binary, held double, moved double"

    def told(left, rank, moved, send, going=True):
        """What a part sends to each: sums for its nodes; to itself its ranks too."""
        import numpy as np
        import pyarrow as pa

        me, sink = left["p"], left["sink"]
        v = [b""] * parts
        if going and send and len(left["src"]):
            sums = np.add.reduceat(rank[left["src"]] * left["w"], left["first"])
            v = [x.tobytes() for x in np.split(sums, np.cumsum(left["sent"])[:-1])]
        to = range(parts) if send else [me]
        n, held = len(to), float(rank[sink].sum())
        table = {"p": pa.array(to, pa.int32()), "f": pa.array([me] * n, pa.int32()), "v": pa.array([v[q] for q in to], pa.binary()), "rank": pa.array([rank.tobytes() if q == me else None for q in to], pa.binary())}
        return pa.table(table | {"held": pa.array([held] * n, pa.float64()), "moved": pa.array([moved] * n, pa.float64())})

    def opened(left):
        import numpy as np

        lists = {c: left.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("b", "sink", "src", "w", "first", "sent", "at")}
        return lists | {"p": left.column("p")[0].as_py(), "sink": lists["sink"].astype(bool), "b": np.asarray(lists["b"], np.float64)}

    def begin(left):
        left = opened(left)
        return told(left, left["b"], float("inf"), True)

    def turn(send):
        def step(left, got):
            import numpy as np

            if not left.num_rows:  # a part without nodes
                return got.slice(0, 0)
            left, got = opened(left), got.sort_by("f")
            whole = lambda c: np.frombuffer(b"".join(got.column(c).drop_null().to_pylist()), np.float64)
            rank, held, moved = whole("rank"), got.column("held").to_numpy().sum(), got.column("moved").to_numpy().sum()
            if moved < least:
                return told(left, rank, 0.0, send, False)
            sums = np.bincount(left["at"], whole("v"), len(rank)) if len(left["at"]) else 0.0
            new = alpha * (sums + held * left["b"]) + (1 - alpha) * left["b"]
            return told(left, new, float(np.abs(new - rank).sum()), send)

        return step

    got = kept.groupBy("p").applyInArrow(begin, kind)
    for n in range(rounds):
        got = kept.groupBy("p").cogroup(got.groupBy("p")).applyInArrow(turn(n < rounds - 1), kind)
        if n % 10 == 9 and n < rounds - 1:
            got = written(got, "rank-round")
            if (got.where("rank is not null").agg(F.sum("moved")).first()[0] or 0.0) < least:
                break
    ranks = written(got.where("rank is not null").select("p", "rank").mapInArrow(unpacked, "p int, i int, rank double"), "ranks")
    kept.unpersist()
    return placed.join(ranks, ["p", "i"]).select("node", "rank")


def pagerank_by_names(nodes: DataFrame, names: DataFrame, alpha: float = 0.85, rounds: int = 50, least: float = 1e-6, part: int = 16384) -> DataFrame:
    """(node, rank): `pagerank` of nodes (node) over all pairs of nodes that share a name, without making the pairs.

    names (node, name, weight) has a node's name once, and all nodes of a name with one weight; the names that a pair shares add their weights to its link.
    What a node gets through a name is what all nodes of the name give to it, less what it gives itself.

    Nodes and names are dealt into parts.  A round is two shuffles: a part sends one number for each name that its nodes have to the part
    where the name is, and gets one back.  Every five rounds are written, which ends the lineage.
    """
    n = nodes.select("node").distinct()
    count = n.count()
    parts = max(1, -(-count // part))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    place = lambda p, c: F.row_number().over(Window.partitionBy(p).orderBy(c)) - 1
    own = written(names.join(n, "node").select("node", "name", "weight"), "rank-names")
    heads = own.groupBy("name").agg(F.count("*").alias("f")).where("f > 1").withColumn("h", dealt("name")).withColumn("j", place("h", "name"))
    shares = written(own.join(heads, "name").select("node", "weight", "f", "h", "j"), "rank-shares")
    sums = shares.groupBy("node").agg(F.sum(F.col("weight") * (F.col("f") - 1)).alias("t"), F.sum("weight").alias("w"))
    placed = n.join(sums, "node", "left").withColumn("p", dealt("node")).withColumn("i", place("p", "node"))
    placed = written(placed.select("node", "p", "i", "t", "w"), "rank-nodes")
    members = written(shares.join(placed.select("node", "p", "i"), "node").select("p", "i", "h", "j", "weight"), "rank-members")
    return ranked_by_names(placed, members, count, parts, alpha, rounds, least)


def ranked_by_names(placed: DataFrame, members: DataFrame, count: int, parts: int, alpha: float, rounds: int, least: float) -> DataFrame:
    """(node, rank) of nodes (node, p, i, t, w), each at place i of its part p, and their names (p, i, h, j, weight), each at place j of part h.

    t is the weight of all links of a node, w that of its names; both are null without links.
    """

    def packed(rows):
        """The names of a part's nodes in order of where they are, and where each name's nodes begin."""
        import numpy as np
        import pyarrow as pa

        i, h, j, w = (rows.column(c).to_numpy() for c in ("i", "h", "j", "weight"))
        order = np.lexsort((i, j, h))
        first = np.flatnonzero(np.diff(h[order], prepend=-1) | np.diff(j[order], prepend=-1))
        lists = {"has": i[order], "first": first, "each": w[order][first], "sent": np.bincount(h[order][first], minlength=parts)}
        return pa.table({"p": rows.column("p").slice(0, 1)} | {c: pa.array([x]) for c, x in lists.items()})

    nodes = placed.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "t", "w"))).alias("own")).select("p", "own.t", "own.w")
    sends = members.groupBy("p").applyInArrow(packed, "p int, has array<int>, first array<long>, each array<double>, sent array<long>")
    came = members.groupBy(F.col("h").alias("p"), F.col("p").alias("of")).agg(F.array_sort(F.collect_set("j")).alias("at"))
    came = came.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("of", "at"))).alias("came")).select("p", F.flatten("came.at").alias("at"), F.col("came.of").alias("of"), F.transform("came.at", F.size).alias("back"))
    every = placed.sparkSession.range(parts).select(F.col("id").cast("int").alias("p"))
    kept = every.join(nodes, "p", "left").join(sends, "p", "left").join(came, "p", "left").repartition(parts, "p").persist()
    kept.count()  # before rounds are planned: how parts lie is known once they do
    kind = "p int, f int, v binary, rank binary, held double, moved double"

    def opened(left):
        lists = {c: left.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("t", "w", "has", "first", "each", "sent", "at", "of", "back")}
        return lists | {"p": left.column("p")[0].as_py()}

    def whole(got, c):
        import numpy as np

        return np.frombuffer(b"".join(got.column(c).drop_null().to_pylist()), np.float64)

    def message(me, v, rank, held, moved):
        """v by the part that it goes to; its ranks go to the part itself, with what is held and how far ranks moved."""
        import pyarrow as pa

        to = sorted({me, *v})
        mine = lambda x, other: [x if q == me else other for q in to]
        lists = {"p": pa.array(to, pa.int32()), "f": pa.array([me] * len(to), pa.int32()), "v": pa.array([v.get(q, b"") for q in to], pa.binary()), "rank": pa.array(mine(rank.tobytes(), None), pa.binary())}
        return pa.table(lists | {"held": pa.array(held(to), pa.float64()), "moved": pa.array(moved(to), pa.float64())})

    def told(left, rank, moved, send, going=True):
        """What a part's nodes give, summed by name; all parts hear what its nodes without links hold and how far it moved."""
        import numpy as np

        v = dict.fromkeys(range(parts) if send else [], b"")
        if going and send and len(left["has"]):
            sums = np.add.reduceat((rank / left["t"])[left["has"]], left["first"])
            v = {q: x.tobytes() for q, x in enumerate(np.split(sums, np.cumsum(left["sent"])[:-1]))}
        held = float(rank[np.isnan(left["t"])].sum())
        return message(left["p"], v, rank, lambda to: [held] * len(to), lambda to: [moved] * len(to))

    def begin(left):
        import numpy as np

        left = opened(left)
        return told(left, np.full(len(left["t"]), 1.0 / max(count, 1)), float("inf"), True)

    def met(left, got):
        """The sums of a part's names go back to the parts that they came from; what all have told goes on within the part."""
        import numpy as np

        left, got = opened(left), got.sort_by("f")
        me, v, held, moved = left["p"], whole(got, "v"), got.column("held").to_numpy().sum(), got.column("moved").to_numpy().sum()
        back = {}
        if len(v):
            sums = np.bincount(left["at"], v)[left["at"]]
            back = {int(q): x.tobytes() for q, x in zip(left["of"], np.split(sums, np.cumsum(left["back"])[:-1]))}
        return message(me, back, whole(got, "rank"), lambda to: [held if q == me else 0.0 for q in to], lambda to: [moved if q == me else 0.0 for q in to])

    def turn(send):
        def step(left, got):
            import numpy as np

            left, got = opened(left), got.sort_by("f")
            rank, held, moved = whole(got, "rank"), got.column("held").to_numpy().sum(), got.column("moved").to_numpy().sum()
            if moved < least:
                return told(left, rank, 0.0, send, False)
            sums = np.zeros(len(rank))
            if len(left["has"]):
                each = np.repeat(left["each"] * whole(got, "v"), np.diff(left["first"], append=len(left["has"])))
                sums = np.bincount(left["has"], each, len(rank)) - np.nan_to_num(rank / left["t"] * left["w"])
            new = alpha * (sums + held / max(count, 1)) + (1 - alpha) / max(count, 1)
            return told(left, new, float(np.abs(new - rank).sum()), send)

        return step

    got = kept.groupBy("p").applyInArrow(begin, kind)
    for n in range(rounds):
        names = kept.groupBy("p").cogroup(got.groupBy("p")).applyInArrow(met, kind)
        got = kept.groupBy("p").cogroup(names.groupBy("p")).applyInArrow(turn(n < rounds - 1), kind)
        if n % 5 == 4 and n < rounds - 1:
            got = written(got, "rank-round")
            if (got.where("rank is not null").agg(F.sum("moved")).first()[0] or 0.0) < least:
                break
    ranks = written(got.where("rank is not null").select("p", "rank").mapInArrow(unpacked, "p int, i int, rank double"), "ranks")
    kept.unpersist()
    return placed.join(ranks, ["p", "i"]).select("node", "rank")


def walks(seeds: DataFrame, links: DataFrame, alpha: float = 0.85, rounds: int = 50, least: float = 1e-6) -> DataFrame:
    """(query_id, node, rank): personalised PageRank of every query's own seeds (query_id, node, weight) over undirected links (a, b).

    All queries walk at once, and only nodes that a walk has reached are held.  What stands on a node
    without links is lost but for its own seed.  Ranks are checkpointed and compared every five rounds.  A walk of a long reach has a row for each of its nodes, which are dealt by node.
    """
    ensure_checkpoints(seeds.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    share = both.join(both.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", (F.lit(1.0) / F.col("n")).alias("p")).checkpoint()
    clean = seeds.groupBy("query_id", "node").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("w")).where("w > 0")
    base = clean.withColumn("b", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).select("query_id", "node", "b").checkpoint()
    rank = base.select("query_id", "node", F.col("b").alias("rank"))
    for first in range(0, rounds, 5):
        before = rank
        for _ in range(first, min(first + 5, rounds)):
            sent = rank.join(share, rank["node"] == share["a"]).select("query_id", F.col("b").alias("node"), (alpha * F.col("rank") * F.col("p")).alias("r"))
            again = base.select("query_id", "node", ((1 - alpha) * F.col("b")).alias("r"))
            rank = sent.unionByName(again).groupBy("query_id", "node").agg(F.sum("r").alias("rank"))
        rank = rank.checkpoint()
        change = rank.unionByName(before.select("query_id", "node", (-F.col("rank")).alias("rank"))).groupBy("query_id", "node").agg(F.abs(F.sum("rank")).alias("m"))
        moved = change.groupBy("query_id").agg(F.sum("m").alias("m")).agg(F.max("m")).first()[0] or 0.0
        if moved < least:
            break
    return rank


def summed(values, index, first):
    """Sums of values[index] over runs, which begin at `first` and have one index at least; some million at a time."""
    import numpy as np

    ends = np.append(first, len(index))
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(index), 1 << 20)), len(first)))
    return np.concatenate([np.zeros(0), *(np.add.reduceat(values[index[ends[a] : ends[b]]], first[a:b] - first[a]) for a, b in zip(cuts, cuts[1:]))])


def best_walked(seeds: DataFrame, mentions: DataFrame, k: int, alpha: float = 0.85, rounds: int = 50, block: int = 8, part: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k documents that each query's walk visits most; ids are strings.

    seeds (query_id, entity, doc_id, weight), of which either entity or doc_id is null; mentions (doc_id, entity).  The ranks are those of `walks`
    over the mentions after `rounds` rounds, an even number.  Links lead from documents to entities and back alone, so what documents hold in an even round follows
    from what they held two rounds before: half of the nodes are held in each round.

    Queries don't meet on their walks, so these are dealt by query: the query set, which the caller states, is cut into blocks, and a block's task gets the
    whole graph, four bytes a link, in rows of about `part` documents, and walks for one query after the other.  What is shuffled is the graph once a block and
    the seeds, whatever the rounds; a task holds some 30 bytes a link and a few numbers a node.
    """
    links = written(mentions.select(F.col("doc_id").cast("string").alias("doc"), "entity").where("doc is not null and entity is not null").distinct(), "walk-links")
    parts = max(1, -(-links.select("doc").distinct().count() // part))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    order = Window.partitionBy("p").orderBy("entity")
    # a number for each entity, by its part and its place there
    entities = written(links.select("entity").distinct().withColumn("p", dealt("entity")).select("entity", ((F.row_number().over(order) - 1) * parts + F.col("p")).cast("int").alias("code")), "walk-entities")
    docs = links.join(entities, "entity").groupBy("doc").agg(F.sort_array(F.collect_list("code")).alias("codes")).withColumn("p", dealt("doc"))
    rows = docs.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("doc", "codes"))).alias("d"))
    graph = written(rows.select("p", F.col("d.doc").alias("ids"), F.transform("d.codes", F.size).alias("n"), F.flatten("d.codes").alias("codes")), "walk-graph")
    clean = seeds.groupBy("query_id", F.col("doc_id").cast("string").alias("doc"), "entity").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("w")).where("w > 0")
    clean = written(clean.withColumn("b", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))), "walk-seeds")
    return top_k(walked(graph, entities, clean, k, alpha, rounds // 2, block), k)


def walked(graph: DataFrame, entities: DataFrame, clean: DataFrame, k: int, alpha: float, rounds: int, block: int) -> DataFrame:
    """(query_id, id, score): the k best documents of each query, by graph (p, ids, n, codes), entities (entity, code) and seeds (query_id, doc, entity, b)."""
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

    spark = graph.sparkSession
    names = sorted(r[0] for r in clean.select("query_id").distinct().collect())  # the query set, as the caller states it
    kind = clean.schema["query_id"].dataType
    query_kind = to_arrow_type(kind)
    blocks = max(1, -(-len(names) // block))
    # blocks are named so that each has a task to itself
    spread = spark.range(64 * blocks).groupBy(F.pmod(F.hash("id"), F.lit(blocks)).alias("t")).agg(F.min("id").alias("id"))
    keys = [r.id for r in spread.orderBy("t").collect()]
    places = spark.createDataFrame([(q, keys[i % len(keys)], i) for i, q in enumerate(names)], StructType([StructField("query_id", kind), StructField("block", LongType()), StructField("i", IntegerType())]))
    own = clean.join(F.broadcast(places), "query_id")
    at = graph.select(F.col("p").alias("of"), F.posexplode("ids").alias("at", "doc"))
    begins = own.join(at, "doc").select("block", "i", "of", "at", "b").unionByName(own.join(entities, "entity").select("block", "i", F.lit(None).cast("int").alias("of"), F.col("code").alias("at"), "b"))
    kinds = StructType([StructField("query_id", kind), StructField("id", StringType()), StructField("score", DoubleType())])
    out = to_arrow_schema(kinds)

    def walk(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.sort_by("p").select(["p", "ids", "n", "codes"])
        ids, n, codes = (left.column(c).combine_chunks().flatten() for c in ("ids", "n", "codes"))
        n, codes = n.to_numpy(), codes.to_numpy()
        order = np.argsort(codes, kind="stable")
        begin = np.flatnonzero(np.diff(codes[order], prepend=-1))  # of each entity's links
        known, m = codes[order[begin]], np.diff(begin, append=len(codes))
        codes = np.searchsorted(known, codes).astype(np.int32)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        del order
        first = np.cumsum(n, dtype=np.int64) - n
        # where a part's documents begin
        p = left.column("p").to_numpy()
        starts = np.zeros(p[-1] + 1, np.int64)
        starts[p] = np.cumsum(sizes := pc.list_value_length(left.column("ids")).to_numpy()) - sizes
        query, some = right.column("i").to_numpy(), right.column("of").is_valid().to_numpy(zero_copy_only=False)
        place, b = right.column("at").to_numpy().astype(np.int64), right.column("b").to_numpy()
        place[some] += starts[right.column("of").drop_null().to_numpy()]
        place[~some] = np.searchsorted(known, place[~some])
        for q in np.unique(query):
            own, named = np.zeros(len(n)), np.zeros(len(m))
            for base, mine in ((own, (query == q) & some), (named, (query == q) & ~some)):
                np.add.at(base, place[mine], b[mine])
            hold = own
            for _ in range(rounds):
                met = (alpha * summed(hold / n, doc, begin) + (1 - alpha) * named) / m
                hold = alpha * summed(met, codes, first) + (1 - alpha) * own
            key = np.round(hold, 9)
            least = np.partition(key, -min(k, len(key)))[-min(k, len(key))]
            near = np.flatnonzero((key >= least) & (hold > 0.0))
            best = Best(1, k)
            best.offer(hold[near][None], [np.array(ids.take(pa.array(near)).to_pylist(), dtype=str)], 0.0)
            yield from found(best, [names[q]], query_kind, pa.string())

    def step(left, right):
        import pyarrow as pa

        return pa.Table.from_batches(list(walk(left, right)) if left.num_rows and right.num_rows else [], out)

    whole = graph.withColumn("block", F.explode(F.array(*(F.lit(x).cast("long") for x in keys)))).repartition(blocks, "block")
    return whole.groupBy("block").cogroup(begins.repartition(blocks, "block").groupBy("block")).applyInArrow(step, kinds)
