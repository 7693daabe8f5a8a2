"""Connected components of an edge table, by alternating stars; nodes are longs and no row leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import drop, join_counted, materialise


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours and itself to the least of them all. Least values are sums
    by key, so a node with very many neighbours is combined before the shuffle, and join_counted brings them to the
    neighbours without gathering those of a heavy node. total: no less than the number of pairs."""
    if not large:
        pairs = pairs.filter("b < a")
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    kept = pairs.filter("b > a") if large else pairs
    out = join_counted(kept, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) -> (node, component): the least node that is reachable; nodes without edges to others are left out.

    Null ends and loops are dropped, and repeated edges count once. Ends when a round changes nothing; a graph that hasn't
    settled after so many rounds raises, as a partial answer would be wrong.
    """
    now = materialise(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        mid = materialise(_star(_undirected(now), True, 2 * seen[0]), "stars")
        new = materialise(_star(mid, False, 2 * seen[0]), "edges")
        drop(now)
        drop(mid)
        now, was = new, seen
        seen = digest(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
