"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_groups


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones and itself) go to its smallest neighbour."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = edges.unionByName(flipped) if large else edges
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = with_groups(sides, least, "u", ["v"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v: long), component being its smallest reachable node.

    Nodes without an edge to another node are not returned. Rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder, so a lost executor costs one round, and
    hot nodes are salted. Null ends and self loops are ignored; an empty table gives an empty one."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first())
        if now[0] == 0 or now == mark:
            break
        mark = now
        edges = cut(_star(_star(edges, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
