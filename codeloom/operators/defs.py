"""Symbols with several definitions: the one that stands for the symbol, its kind, its place, its representative declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def any_def(defs: DataFrame) -> DataFrame:
    """For each usr the first definition (by ord) that has a spelling, else the last one."""
    spelled = F.col("spell_p").isNotNull()
    order = F.struct((~spelled).cast("int"), F.when(spelled, F.col("ord")).otherwise(-F.col("ord")))
    rest = [c for c in defs.columns if c != "usr"]
    return defs.groupBy("usr").agg(F.min_by(F.struct(*rest), order).alias("b")).select("usr", *[F.col(f"b.{c}").alias(c) for c in rest])


def first_kind(defs: DataFrame) -> DataFrame:
    """Kind of the first definition."""
    return defs.groupBy("usr").agg(F.min_by("kind", "ord").alias("kind"))


def spelling(defs: DataFrame) -> DataFrame:
    """First spelling, null without one."""
    place = F.min_by(F.when(F.col("spell_p").isNotNull(), F.col("spell_p")), F.when(F.col("spell_p").isNotNull(), F.col("ord")))
    return defs.groupBy("usr").agg(place.alias("spell_p"))


def representative(ids: DataFrame, defs: DataFrame, decls: DataFrame) -> DataFrame:
    """(usr, p, is_def): the first spelled definition, else the first declaration; ids with neither are dropped."""
    spelled = spelling(defs).where("spell_p is not null")
    first = decls.groupBy("usr").agg(F.min_by("p", "ord").alias("decl_p"))
    met = ids.join(spelled, "usr", "left").join(first, "usr", "left").where("spell_p is not null or decl_p is not null")
    return met.select("usr", F.coalesce("spell_p", "decl_p").alias("p"), F.col("spell_p").isNotNull().alias("is_def"))


def names_of(ids: DataFrame, files: DataFrame, defs: DataFrame) -> DataFrame:
    """(usr, ekind, name): a file's path, else the name of the symbol's standing definition, else nothing."""
    own = any_def(defs).select("usr", F.col("name").alias("def_name"))
    met = ids.join(files, (ids["ekind"] == 1) & (ids["usr"] == files["file_id"]), "left").join(own, "usr", "left")
    return met.select("usr", "ekind", F.coalesce(F.when(F.col("ekind") == 1, F.col("path")).otherwise(F.col("def_name")), F.lit("")).alias("name"))
