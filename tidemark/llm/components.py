"""Connected components of an edge table, by rounds of star contraction.

Every round rewrites the edge table: each node links its larger
neighbours to its smallest one (large star), then its smaller ones (small
star).  The table shrinks to one star per component in O(log^2 n) rounds.
Each round's table is written to the shared checkpoint folder, so a lost
executor costs one round at most.  Groups are only aggregated (min) and
joined; no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) with u > v kept once per pair."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        linked = both.join(low, "u").filter(F.col("v") > F.col("u"))
        return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u")
    out = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free digests of an edge table (rows are distinct)."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges``: two columns u, v of one orderable type, u <> v; either direction,
    repeats allowed.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        now, before = cut_lineage(_star(_star(now, True), False), "edges"), mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
