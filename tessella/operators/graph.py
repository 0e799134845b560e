"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import Tables, discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, tables: Tables | None = None) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``: the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star rounds until the edge set stands still. A node with very many edges
    costs one partial minimum, never a group in one task. Null ends and self-loops are ignored. The result's table is one of
    ``tables``, if given.
    """
    e = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        nxt = materialize(_small_star(_large_star(e)))
        # a sum of 40-bit hashes can't overflow a long below 2^23 times as many edges as a table can hold here
        now = tuple(nxt.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        discard(e)
        e = nxt
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    if tables is not None:
        tables.kept.append(e)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
