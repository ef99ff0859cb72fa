"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations and two joins over tables in the shared folder; no key's neighbours are ever gathered
in one task: minima are partial aggregates and the joins may split a hot key. Nothing but two counters per round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

#: The steps end when nothing changes, after O(log^2 n) rounds; this only stops an endless loop.
ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    n, mixed = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(mixed or 0)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, component): the smallest node reachable, for every node with an edge.

    Self-loops and repeated pairs are harmless; an empty table gives an empty result.
    """
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        old, edges = edges, keep(small, "edges")
        discard(old)
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
