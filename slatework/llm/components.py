"""Connected components of an edge table by alternating stars.

Large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every edge is re-hung on the smallest neighbour
until each component is a star. Only (node, node) rows move; each round is
written to the shared folder, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    near = _both(e)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(``u``, ``v``) pairs -> (``node``, ``root``): root is the smallest node
    reachable. Nodes without an edge to another node are absent; an empty
    table gives an empty table. Raises if ``rounds`` do not suffice (they
    grow with the logarithm of the component size)."""
    cur = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    mark = None
    for _ in range(rounds):
        nxt = stored(_small_star(_large_star(cur).distinct()).distinct(), "stars")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        cur, mark = nxt, now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
