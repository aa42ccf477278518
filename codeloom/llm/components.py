"""Connected components of an edge table by alternating large and small stars, DataFrame operations only.

A node's neighbours meet only in mergeable minima and in joins whose sides are both plain shuffles, so a
node with very many neighbours is pre-aggregated and its join partition can be split by adaptive execution.
Each round is a written table; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = store(edges.groupBy("u").agg(F.min("v").alias("m")), "small")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    Loops and repeated edges change nothing; an empty table gives an empty result.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = store(ordered, "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        if state[0] == 0:
            break
        now = store(_small(store(_large(now), "edges")), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
