"""Connected components of an edge table, entirely as DataFrame joins and aggregates.

Alternating large-star / small-star rounds: in each round every node learns the smallest id in its
neighbourhood and re-hangs its larger (or smaller) neighbours there, until the edges are stars
around each component's smallest node. Edges and labels never reach the driver; every round is
written to the shared folder, which cuts the lineage and survives lost executors. Minima are partial
aggregates (map-side), and the joins on a hub node are left to AQE's skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a"), F.least("a", "m").alias("m"))
    moved = both.join(least, "a").where("b > a" if large else "b <> m").select(
        F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60, release: bool = False) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node id.

    ``edges`` has long columns ``a`` and ``b``; loops, duplicates and either direction are fine,
    rows with a NULL end are ignored. An empty table gives an empty result. With ``release`` a round's
    table is deleted when the next one is written.
    """
    current = materialise(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # (a, b): a > b; stars around the smallest id are the fixed point
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if state == before or state.n == 0:
            break
        before = state
        done, current = current, materialise(_star(_star(current, True), False), "edges")
        if release:
            forget(done)
    else:
        raise RuntimeError("connected components did not converge")
    hubs = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(hubs)
