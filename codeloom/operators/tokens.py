"""Token streams: delta encoding, disjoint segments of overlapping ranges, outlines, token types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LINE


def delta_encode(tokens: DataFrame) -> DataFrame:
    """Lines and columns relative to the token before in the file; a new line starts columns afresh."""
    w = Window.partitionBy("file_id").orderBy("start_p")
    line, col = F.floor(F.col("start_p") / LINE), F.pmod("start_p", F.lit(LINE))
    own = tokens.withColumn("_line", line).withColumn("_col", col)
    last = F.lag("_line", 1, 0).over(w)
    d_col = F.col("_col") - F.when(F.col("_line") == last, F.lag("_col", 1, 0).over(w)).otherwise(0)
    return own.withColumn("d_line", F.col("_line") - last).withColumn("d_col", d_col).withColumn("len", F.col("end_p") - F.col("start_p")).drop("_line", "_col")


def disjoint_segments(ranges: DataFrame) -> DataFrame:
    """Elementary segments (file_id, lo, hi) with the shortest range (then the latest start, then the least id) that covers each."""
    ends = ranges.select("file_id", F.explode(F.array("start_p", "end_p")).alias("lo")).distinct()
    segments = ends.withColumn("hi", F.lead("lo").over(Window.partitionBy("file_id").orderBy("lo"))).where("hi is not null")
    own = ranges.select(F.col("file_id").alias("r_file"), "start_p", "end_p", "scope_id")
    met = segments.join(own, (F.col("file_id") == F.col("r_file")) & (F.col("start_p") <= F.col("lo")) & (F.col("hi") <= F.col("end_p")))
    return met.groupBy("file_id", "lo", "hi").agg(F.min_by("scope_id", F.struct(F.col("end_p") - F.col("start_p"), -F.col("start_p"), F.col("scope_id"))).alias("scope_id"))


def outline_parents(extents: DataFrame) -> DataFrame:
    """(file_id, scope_id, parent): in order of start, then descending end, then id, a row's parent is the last earlier row that ends after its start."""
    p = extents.select(F.col("file_id").alias("p_file"), F.col("start_p").alias("p_start"), F.col("end_p").alias("p_end"), F.col("scope_id").alias("p_id"))
    earlier = F.struct(F.col("p_start"), -F.col("p_end"), F.col("p_id")) < F.struct(F.col("start_p"), -F.col("end_p"), F.col("scope_id"))
    on = (F.col("file_id") == F.col("p_file")) & (F.col("p_start") <= F.col("start_p")) & (F.col("p_end") > F.col("start_p")) & earlier
    return extents.join(p, on, "left").groupBy("file_id", "scope_id").agg(F.max_by("p_id", F.struct(F.col("p_start"), -F.col("p_end"), F.col("p_id"))).alias("parent"))


def token_types(entities: DataFrame) -> DataFrame:
    """usr, token type (a static method is a method, the kinds from 252 on follow the others), rainbow number, modifier bits."""
    kind = F.when(F.col("kind") == 254, 6).when(F.col("kind") >= 252, F.col("kind") - 225).otherwise(F.col("kind"))
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    modifiers = bit(F.col("storage") == 2, 0).bitwiseOR(bit(F.col("ekind") == 3, 1)).bitwiseOR(bit(F.col("parent_kind").isin(6, 12), 2))
    return entities.select("usr", kind.alias("token_type"), F.pmod("usr", F.lit(20)).alias("rainbow"), modifiers.alias("modifiers"))
