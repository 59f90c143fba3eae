"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import join_salted, stored, work_dir


class Forest:
    """Union-find over positions 0..n-1; the root is the smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _least(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself: ``u, m``. Partial minima go before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 64) -> DataFrame:
    """``links``: ``u, v`` (long, not null). Returns ``u, root`` for each node but the roots: root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes; the rounds
    grow with the logarithm of the nodes. Each round is written to the shared
    folder. No component is gathered: a hub's links are dealt over several tasks,
    each with the one row that holds its minimum. An empty table gives an empty result.
    """
    spark, base = links.sparkSession, work_dir(links.sparkSession, name)
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/0")
    state = None
    for k in range(1, most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_salted(both, _least(both), "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{base}/{k}")
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            return edges.select("u", F.col("v").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
