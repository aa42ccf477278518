"""Overlaps of ranges within a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Open intersection."""
    return (a_start < b_end) & (b_start < a_end)


def includes(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed inclusion of b in a."""
    return (a_start <= b_start) & (b_end <= a_end)


def overlap_counts(scopes: DataFrame) -> DataFrame:
    """(scope_id, n_intersecting, n_included): the other ranges of its file that a range meets, and those within it."""
    b = scopes.select(F.col("file_id").alias("b_file"), F.col("start_p").alias("b_start"), F.col("end_p").alias("b_end"), F.col("scope_id").alias("b_id"))
    met = scopes.join(b, (F.col("file_id") == F.col("b_file")) & (F.col("scope_id") != F.col("b_id")))
    own = [F.col(c) for c in ("start_p", "end_p", "b_start", "b_end")]
    return met.groupBy("scope_id").agg(F.count(F.when(intersects(*own), 1)).alias("n_intersecting"), F.count(F.when(includes(*own), 1)).alias("n_included"))


def quick_fixes(wanted: DataFrame, fixes: DataFrame) -> DataFrame:
    """(scope_id, diag_id): fixes (diag_id, file_id, start_p, end_p, edits) whose diagnostic or any edit meets a wanted range."""
    w = wanted.select(F.col("file_id").alias("w_file"), F.col("start_p").alias("w_start"), F.col("end_p").alias("w_end"), "scope_id")
    at = (F.col("w_start"), F.col("w_end"))
    meets = reduce(lambda a, b: a | b, [intersects(F.col("start_p"), F.col("end_p"), *at), F.exists("edits", lambda e: intersects(e["start_p"], e["end_p"], *at))])
    return fixes.join(w, (F.col("file_id") == F.col("w_file")) & meets).select("scope_id", "diag_id")
