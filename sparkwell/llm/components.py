"""Connected components of edges between 64-bit nodes: alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _round(e: DataFrame) -> DataFrame:
    """e: distinct (u, v) with u > v.  Every node hangs itself and its larger neighbours on its smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge; label: the smallest node of its component.  edges: (u, v), either order."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        e = _round(e).checkpoint()
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class Forest:
    """Union-find that tells which edges join what wasn't joined, so that a task emits fewer edges than nodes."""

    def __init__(self, most: int = 1_000_000):
        self.up, self.most = {}, most

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def joins(self, x, y) -> bool:
        if len(self.up) > self.most:
            self.up.clear()  # edges may then come twice, none is lost
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
