"""Delta algebra: refcounts, set removal, upserts, monotone stamps, deltas between two states and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import OCC_KEY


def refcount(changes: DataFrame, key: tuple[str, ...] = OCC_KEY) -> DataFrame:
    """Rows with their count of additions less removals (column delta), those above zero only."""
    return changes.groupBy(*key).agg(F.sum("delta").alias("refcnt")).where("refcnt > 0")


def remove(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Set removal: every row that equals a removed one in the key goes, however often it occurs."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, mergeable before the exchange."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*key, *[F.col(f"b.{c}") for c in rest])


def create(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, delta): +1 for each row that came, -1 for each that went; rows in both fall out."""
    signed = before.select(*key, F.lit(-1).alias("delta")).unionByName(after.select(*key, F.lit(1).alias("delta")))
    return signed.groupBy(*key).agg(F.sum("delta").alias("delta")).where("delta <> 0")


def apply(state: DataFrame, change: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """State (key, refcnt) after a delta (key, delta); rows at zero are dropped."""
    signed = state.select(*key, F.col("refcnt").alias("delta")).unionByName(change.select(*key, F.col("delta").cast("long").alias("delta")))
    return refcount(signed, key)


def accepted(updates: DataFrame) -> DataFrame:
    """Updates (path, seq, ts, step) that are newer than all before them in their path: by ts, then step."""
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stamp = F.struct("ts", "step")
    return updates.withColumn("_last", F.max(stamp).over(before)).where(F.col("_last").isNull() | (stamp > F.col("_last"))).drop("_last")


def keep_newest(updates: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of each path, numbered from the newest."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return updates.withColumn("age", F.row_number().over(w).cast("long")).where(F.col("age") <= n)


def answered(requests: DataFrame, updates: DataFrame, wait: int) -> DataFrame:
    """Each request (req_id, path, at) with the first update of its path from then on, or overdue after ``wait`` seconds."""
    u = updates.select(F.col("path").alias("u_path"), F.col("at").alias("u_at"))
    met = requests.join(u, (F.col("path") == F.col("u_path")) & (F.col("u_at") >= F.col("at")) & (F.col("u_at") <= F.col("at") + wait), "left")
    return met.groupBy("req_id", "path", "at").agg(F.min("u_at").alias("answered_at")).withColumn("overdue", F.col("answered_at").isNull())


def debounced(events: DataFrame, delay: int) -> DataFrame:
    """Events (path, seq, at) that schedule a run: none is pending in their path, where a run is pending for ``delay`` seconds.

    A fold in order of time, so session windows (which an event extends) would not do.
    """

    def fold(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["at", "seq"])
        keep, due = [], None
        for t in pdf["at"].tolist():
            fresh = due is None or t >= due
            keep.append(fresh)
            due = t + delay if fresh else due
        return pdf[keep]

    return events.groupBy("path").applyInPandas(fold, events.schema)
