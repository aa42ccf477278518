"""Positions to symbols: point lookups, enclosing scopes and neighbours as interval and as-of joins.

Every join has the file as an equality key. Files with very many extents can be cut further: ``scope_of`` bins
positions, so that a file's rows spread over many join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LINE, ROLE, line_of, unsigned_order

MANY = 2**31 - 1


def range_size(start: Column, end: Column) -> Column:
    """Columns of a range within one line; the largest int for one over several lines."""
    return F.when(line_of(start) == line_of(end), end - start).otherwise(F.lit(MANY)).cast("long")


def covers(start: Column, end: Column, p: Column) -> Column:
    """Half-open containment of a point."""
    return (start <= p) & (p < end)


def live(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("refcnt > 0")


def cursor_order() -> list[Column]:
    """Smallest range first, then dynamic, then definitions, then the higher kind, then the unsigned id."""
    return [
        range_size(F.col("start_p"), F.col("end_p")),
        F.col("role").bitwiseAND(ROLE["dynamic"]).desc(),
        F.col("role").bitwiseAND(ROLE["definition"]).desc(),
        F.col("ekind").desc(),
        unsigned_order(F.col("usr")),
        F.col("start_p"),
        F.col("role"),
    ]


def symbols_at(cursors: DataFrame, occurrences: DataFrame, smallest: bool = False) -> DataFrame:
    """Live occurrences that cover each cursor (cursor_id, file_id, p), ranked by cursor_order.

    ``smallest`` keeps the leading rows that share range and kind with the first one.
    """
    own = live(occurrences).withColumnRenamed("file_id", "occ_file")
    met = cursors.join(own, (F.col("file_id") == F.col("occ_file")) & covers(F.col("start_p"), F.col("end_p"), F.col("p"))).drop("occ_file")
    by = Window.partitionBy("cursor_id").orderBy(*cursor_order())
    ranked = met.withColumn("rank", F.row_number().over(by).cast("long"))
    if not smallest:
        return ranked
    first = F.first(F.struct("start_p", "end_p", "ekind")).over(by)
    same = F.min((first == F.struct("start_p", "end_p", "ekind")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_same", same).where("_same = 1").drop("_same")


def scope_of(uses: DataFrame, scopes: DataFrame, keys: list[str], bin_size: int | None = None) -> DataFrame:
    """For each use (file_id, start_p, end_p, *keys) the scope (scope_id) with the greatest start that contains it.

    Equal starts: the smaller end, then the unsigned id. With ``bin_size``, scopes are copied to each bin that they
    touch and a use looks in the bin of its start only.
    """
    own = scopes.select(F.col("file_id").alias("s_file"), F.col("start_p").alias("s_start"), F.col("end_p").alias("s_end"), "scope_id")
    on = (F.col("file_id") == F.col("s_file")) & (F.col("s_start") <= F.col("start_p")) & (F.col("end_p") <= F.col("s_end"))
    left = uses
    if bin_size:
        bins = F.sequence(F.floor(F.col("s_start") / bin_size), F.floor(F.col("s_end") / bin_size))
        own = own.withColumn("s_bin", F.explode(bins))
        left = uses.withColumn("u_bin", F.floor(F.col("start_p") / bin_size))
        on = on & (F.col("u_bin") == F.col("s_bin"))
    best = F.max_by(F.struct("scope_id", "s_start", "s_end"), F.struct(F.col("s_start"), -F.col("s_end"), F.bitwise_not(unsigned_order(F.col("scope_id"))))).alias("best")
    return left.join(own, on).groupBy(*keys).agg(best).select(*keys, "best.scope_id", F.col("best.s_start").alias("scope_start"), F.col("best.s_end").alias("scope_end"))


def navigate(cursors: DataFrame, extents: DataFrame, direction: str) -> DataFrame:
    """One extent per cursor (cursor_id, file_id, p): D first child, L previous sibling, R next sibling, U parent.

    The parent of a point is the extent that contains it with the greatest start, of equal starts the larger end.
    """
    e = extents.select(F.col("file_id").alias("e_file"), F.col("start_p").alias("e_start"), F.col("end_p").alias("e_end"))
    met = cursors.join(e, F.col("file_id") == F.col("e_file"))
    keys = ["cursor_id", "file_id", "p"]
    pick = lambda rows, order: rows.groupBy(*keys).agg(F.max_by(F.struct("e_start", "e_end"), order).alias("b")).select(*keys, F.col("b.e_start").alias("start_p"), F.col("b.e_end").alias("end_p"))
    if direction == "U":
        return pick(met.where("e_start < p and p < e_end"), F.struct("e_start", "e_end"))
    parent = pick(met.where("e_start <= p and p < e_end"), F.struct("e_start", "e_end")).select("cursor_id", F.col("start_p").alias("par_start"), F.col("end_p").alias("par_end"))
    met = met.join(parent, "cursor_id", "left")
    if direction == "D":
        return pick(met.where("e_start > p and (par_end is null or e_end <= par_end)"), F.struct(-F.col("e_start"), F.col("e_end")))
    if direction == "L":
        return pick(met.where("e_end <= p"), F.struct(F.col("e_end"), -F.col("e_start")))
    # next sibling: from the end of a parent that starts on the cursor's line, else from the cursor
    at = F.when((F.floor(F.col("par_start") / LINE) == F.floor(F.col("p") / LINE)), F.col("par_end") - (F.pmod("par_end", F.lit(LINE)) > 0).cast("long")).otherwise(F.col("p"))
    return pick(met.where(F.col("e_start") > at), F.struct(-F.col("e_start"), F.col("e_end")))
