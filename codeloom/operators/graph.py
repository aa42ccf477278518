"""Graphs of symbols: closures, level-wise trees, grouped calls, members.

Closures go level by level: the frontier joins the edges, what was seen is dropped by an anti join, and each level is
written to the shared checkpoint folder, so lineage stays short. Edges may have cycles.
"""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels after which bases that lead back to themselves are taken for a cycle.
DEEPEST = 1000


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='codeloom-')}")
    return df.checkpoint()


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, level) of all that a root reaches over edges (src, dst), the root itself left out; level is the shortest distance.
    Levels go on until one finds nothing new."""
    hops = edges.select("src", "dst").distinct()
    seen = durable(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("level")).distinct())
    front, total = seen, seen
    for level in itertools.count(1):
        step = front.join(hops, front["node"] == hops["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = durable(step.join(total.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        total = total.unionByName(front)
    return total.where("level > 0")


def tree(roots: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """(root, level, parent, node): the children of each node once, level by level. A node met again is opened again, as in a tree."""
    hops = edges.select("src", "dst").distinct()
    front = roots.select("root", F.col("root").alias("node"))
    out = None
    for level in range(1, levels + 1):
        step = front.join(hops, front["node"] == hops["src"]).select("root", F.lit(level).alias("level"), F.col("src").alias("parent"), F.col("dst").alias("node"))
        out = step if out is None else out.unionByName(step)
        front = step.select("root", "node").distinct()
    return out.distinct()


def full_tree(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, level, parent, node) down to the last level, a row for each way that leads to a node; edges in a cycle are an error."""
    hops = edges.select("src", "dst").distinct()
    front, out = durable(roots.select("root", F.col("root").alias("node"))), None
    for level in range(1, DEEPEST + 1):
        step = durable(front.join(hops, front["node"] == hops["src"]).select("root", F.lit(level).alias("level"), F.col("src").alias("parent"), F.col("dst").alias("node")))
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            return out
        front = step.select("root", "node")
    raise ValueError(f"edges go on after {DEEPEST} levels: they have a cycle")


def child_counts(edges: DataFrame) -> DataFrame:
    """(node, num_children, distinct_children): edges before and after equal ones are merged."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("num_children"), F.countDistinct("dst").alias("distinct_children"))


def flatten(trees: DataFrame) -> DataFrame:
    """All nodes below a root, each once."""
    return trees.select("root", "node").distinct()


def grouped_calls(calls: DataFrame, by: str, other: str) -> DataFrame:
    """Calls (file_id, start_p, by, other) grouped by pair; only places in the pair's first file (least file, then place) are kept."""
    first = calls.groupBy(by, other).agg(F.min("file_id").alias("file_id"))
    kept = calls.join(first, [by, other, "file_id"])
    return kept.groupBy(by, other, "file_id").agg(F.count("*").alias("n_ranges"), F.min("start_p").alias("first_p"), F.max("start_p").alias("last_p"))
