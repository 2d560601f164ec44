"""Links between documents by the rare names that they share, and communities of linked documents by modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkwell.storage import written

#: A name that more documents have isn't rare: it links nothing.
RARE = 64
#: Each document of a name in a chain is linked to so many that follow it.
REACH = 2


def rare_names(mentions: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc_id, entity, weight) of mentions (doc_id, entity) whose entity two documents or more have, and `rare` at most.

    An entity that f documents have weighs 1 / log2(1 + f).  Null ids and entities are left out; a repeated mention counts once.
    """
    own = mentions.where(F.col("doc_id").isNotNull() & F.col("entity").isNotNull()).select("doc_id", "entity").distinct()
    freq = own.groupBy("entity").agg(F.count("*").alias("f")).where(F.col("f").between(2, rare))
    return own.join(freq, "entity").select("doc_id", "entity", (1.0 / F.log2(1.0 + F.col("f"))).alias("weight"))


def shared_names(mentions: DataFrame, rare: int | None = None, reach: int | None = None) -> DataFrame:
    """(a, b, weight), a < b: all pairs of documents that share a rare entity of mentions (doc_id, entity); each such entity adds its weight.

    Entities are rare that two documents or more have, and RARE at most, so a mention makes RARE - 1 links at most.

    A caller that states `rare` or `reach` gets chains, of entities that `rare` documents have at most: the documents of an entity stand in
    order of id, and each is linked to the `reach` (else REACH) that follow.
    """
    rows = rare_names(mentions, RARE if rare is None else rare)
    if rare is None and reach is None:
        sets = rows.groupBy("entity").agg(F.array_sort(F.collect_list("doc_id")).alias("d"), F.first("weight").alias("w")).select("w", "d", F.posexplode("d").alias("i", "a"))
        pairs = sets.select("a", F.explode(F.slice("d", F.col("i") + 2, F.size("d"))).alias("b"), "w")
    else:
        order = Window.partitionBy("entity").orderBy("doc_id")  # no more than `rare` rows
        ahead = F.array_compact(F.array(*(F.lead("doc_id", k).over(order) for k in range(1, (REACH if reach is None else reach) + 1))))
        pairs = rows.select("doc_id", ahead.alias("next"), F.col("weight").alias("w")).select(F.col("doc_id").alias("a"), F.explode("next").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def both_ways(links: DataFrame) -> DataFrame:
    """(src, dst, weight) in either direction; a link to itself counts twice, as it does for degrees."""
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def met(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """An inner join whose sides are both dealt by key: of dozens of rounds none collects a side to broadcast it."""
    return left.join(right.hint("merge"), by)


def modularity(links: DataFrame, communities: DataFrame) -> float:
    """Of links (a, b, weight) and communities (node, community); 0 without links."""
    named = communities.select("node", "community")
    of = lambda c: named.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
    rows = both_ways(met(met(links, of("a"), "a"), of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), "weight"))
    per = rows.groupBy("src").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("inner"))
    of_all = per.agg(F.sum("all").alias("t"), F.sum("inner").alias("i"), F.sum(F.pow("all", F.lit(2.0))).alias("s")).first()
    return of_all.i / of_all.t - of_all.s / of_all.t**2 if of_all.t else 0.0


def by_links(outer: DataFrame):
    """What nodes that may move find around them, by links (src, dst, weight) without those of a node to itself: (node, community, w, tot) for each link."""

    def near(placed: DataFrame, may) -> DataFrame:
        there = placed.select(F.col("node").alias("dst"), "community", "tot")
        return met(outer.where(may("src")), there, "dst").select(F.col("src").alias("node"), "community", F.col("weight").alias("w"), "tot")

    return near


def by_names(names: DataFrame):
    """The same over all pairs of nodes that share a name of names (node, name, weight): a row for each name and community that has nodes of the name."""

    def near(placed: DataFrame, may) -> DataFrame:
        at = met(names, placed.select("node", "community", "tot"), "node")
        has = at.groupBy("name", "community").agg(F.count("*").alias("n"), F.first("tot").alias("tot"))
        rows = met(at.where(may("node")).select("name", "node", "weight", F.col("community").alias("own")), has, "name")
        others = F.col("n") - (F.col("community") == F.col("own")).cast("int")
        return rows.where(others > 0).select("node", "community", (F.col("weight") * others).alias("w"), "tot")

    return near


def moved(near, now: DataFrame, total: float, turn: int) -> DataFrame:
    """(node, k, community, moves): each node of this turn's half in the neighbouring community that gains most, others where they are.

    near is of `by_links` or `by_names`; now (node, k, community), k being a node's degree.  Only half of the
    nodes, by a hash that changes every second turn, may move, so that two that would change places don't; turns 2 n and 2 n + 1 reach all.
    Only that half's links are dealt.
    """
    may = lambda node: F.pmod(F.xxhash64(node, F.lit(turn // 2)) + turn, F.lit(2)) == 0
    placed = met(now, now.groupBy("community").agg(F.sum("k").alias("tot")), "community")
    movers = placed.where(may("node"))
    # its own community is a choice, linked or not; what a node chooses from is dealt once, by node
    choices = near(placed, may).unionByName(movers.select("node", "community", F.lit(0.0).alias("w"), "tot")).repartition("node").groupBy("node", "community").agg(F.sum("w").alias("w"), F.first("tot").alias("tot"))
    rows = met(choices, movers.select("node", "k", F.col("community").alias("own")), "node")
    stays = F.col("community") == F.col("own")
    gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
    best = rows.groupBy("node").agg(F.first("k").alias("k"), F.max_by("community", F.struct(gain, stays.cast("int"), F.hash("community"))).alias("community"), F.first("own").alias("own"))
    return best.select("node", "k", "community", (F.col("community") != F.col("own")).alias("moves")).unionByName(now.where(~may("node")).withColumn("moves", F.lit(False)))


def settled(near, degrees: DataFrame, total: float, turns: int) -> DataFrame:
    """(node, k, community) of nodes (node, k), each a community of its own at first, when none moves any more or after so many turns."""
    now, still = written(degrees.withColumn("community", F.col("node")), "level"), 0
    for turn in range(turns):
        seen = Observation()
        step = moved(near, now, total, turn).observe(seen, F.count_if("moves").alias("moves"))
        now = written(step, "level").select("node", "k", "community")
        still = still + 1 if not seen.get["moves"] else 0
        if still >= 2 and turn % 2:  # neither half moves
            break
    return now


def named(now: DataFrame) -> DataFrame:
    """(node, community), communities by the smallest of the nodes that they have."""
    names = now.groupBy("community").agg(F.min("node").alias("name"))
    return written(met(now, names, "community").select("node", F.col("name").alias("community")), "named")


def placed_in(of: DataFrame, now: DataFrame) -> DataFrame:
    """(node, community) of nodes whose communities are nodes of now (node, community)."""
    return written(met(of.withColumnRenamed("community", "c"), now.withColumnRenamed("node", "c"), "c").select("node", "community"), "communities")


def louvain(links: DataFrame, turns: int = 12, levels: int = 6, least: float = 1e-4) -> DataFrame:
    """(node, community): communities of links (a, b, weight) by modularity, named by their smallest node.

    Rounds of joins move nodes to where they gain, until none moves; then each community becomes a node and the same is done with
    these, until a level adds less than `least`.  Every round is one job, written to the shared folder.  Nodes without links aren't here.
    """
    base = written(links.select("a", "b", F.col("weight").cast("double").alias("weight")), "links")
    total = 2.0 * (base.agg(F.sum("weight")).first()[0] or 0.0)
    of = written(base.select(F.col("a").alias("node")).union(base.select("b")).distinct().withColumn("community", F.col("node")), "communities")
    if not total:
        return of
    best, edges = modularity(base, of), base
    for _ in range(levels):
        ends = written(both_ways(edges), "ends")
        degrees = ends.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
        now = settled(by_links(ends.where("src <> dst")), degrees, total, turns)
        value = modularity(edges, now)
        if value < best + least:
            break
        best = value
        now = named(now)
        of = placed_in(of, now)
        side = lambda c: now.select(F.col("node").alias(c), F.col("community").alias(f"n_{c}"))  # noqa: E731, B023
        joined = met(met(edges, side("a"), "a"), side("b"), "b")
        edges = written(joined.groupBy(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b")).agg(F.sum("weight").alias("weight")), "links")
    return of


def louvain_by_names(names: DataFrame, turns: int = 12, levels: int = 6, least: float = 1e-4) -> DataFrame:
    """(node, community): `louvain` over all pairs of nodes that share a name, without making the pairs.

    names (node, name, weight) has a node's name once, and all nodes of a name with one weight.  The first level counts a name's nodes by
    community; the links between its communities are the next level's.
    """
    own = written(names.select("node", "name", F.col("weight").cast("double").alias("weight")), "names")
    freq = own.groupBy("name").agg(F.count("*").alias("f")).where("f > 1")
    own = written(met(own, freq, "name"), "names")
    degrees = written(own.groupBy("node").agg(F.sum(F.col("weight") * (F.col("f") - 1)).alias("k")), "degrees")
    own = own.drop("f")
    sums = degrees.agg(F.sum("k").alias("t"), F.sum(F.pow("k", F.lit(2.0))).alias("s")).first()
    if not sums.t:
        return degrees.select("node", F.col("node").alias("community"))
    now = settled(by_names(own), degrees, sums.t, turns)
    of = named(now)
    has = written(met(own, of, "node").groupBy("name", "community").agg(F.count("*").alias("n"), F.first("weight").alias("weight")), "names")
    inner = has.agg(F.sum(F.expr("weight * n * (n - 1)"))).first()[0]
    per = now.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow("k", F.lit(2.0)))).first()[0]
    if inner / sums.t - per / sums.t**2 < least - sums.s / sums.t**2:
        return degrees.select("node", F.col("node").alias("community"))
    one, two = (has.select("name", F.col("community").alias(c), F.col("n").alias(f"n_{c}"), "weight") for c in ("a", "b"))
    pairs = met(one, two.drop("weight"), "name").where("a <= b").select("a", "b", F.expr("weight * n_a * if(a = b, (n_a - 1) / 2, n_b)").alias("weight"))
    edges = pairs.where("weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return placed_in(of, louvain(edges, turns, levels - 1, least))
