"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v long) that is no root; root is the smallest node reachable.

    Each half round takes the minimum of a node's neighbours with map-side partial
    aggregation, writes it and joins what it reads back, so that adaptive execution can split a
    hub's rows over tasks. Self loops and
    repeated edges are allowed; an empty edge table gives an empty result. The number of
    rounds is about the logarithm of the longest chain; `rounds` only stops a runaway loop.
    """
    now = materialize(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    seen = _state(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least-neighbours")
        # large star: each neighbour above u points at the least of u's neighbourhood
        large = materialize(both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct(), "large-star")
        # small star: each neighbour below u, and u itself, points at the least of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest-neighbours")
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        now = materialize(small.unionByName(low.selectExpr("u", "m AS v")).distinct(), "edges", now, least, large, low)
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.selectExpr("u AS node", "v AS root")
