"""The update stream: late ones dropped by monotone stamps, batches applied to stored state, requests awaiting updates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators import delta


def accepted(updates: DataFrame) -> DataFrame:
    """Updates (path, seq, ts, step) newer than all that their path had before, with the newest stamp of each path as state."""

    def run(key: tuple, batches: Iterator[Any], state: GroupState) -> Iterator[Any]:
        import pandas as pd

        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = []
        for stamp in zip(rows["ts"].tolist(), rows["step"].tolist(), strict=True):
            fresh = last is None or stamp > last
            keep.append(fresh)
            last = stamp if fresh else last
        state.update(last)
        yield rows[keep]

    own = updates.select("path", "seq", "ts", "step")
    return own.groupBy("path").applyInPandasWithState(run, own.schema, "ts long, step int", "append", "NoTimeout")


def maintain(changes: DataFrame, path: str, key: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """Apply a stream of (key, delta) rows to a stored state (key, refcnt) at ``path``, batch by batch.

    Versions stand side by side, named by batch: a batch reads the one before and writes its own, so a batch
    that is run again after a failure gives the same state.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        signed = batch.groupBy(*key).agg(F.sum("delta").alias("delta"))
        after = delta.apply(before, signed, key) if before is not None else delta.refcount(signed, key)
        after.write.mode("overwrite").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answered(requests: DataFrame, updates: DataFrame, wait: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Stream join: requests (req_id, path, at) with updates (path, at) of their path within ``wait``; overdue ones come out with nulls once the watermark has passed."""
    r = requests.withWatermark("at", late).alias("r")
    u = updates.withWatermark("at", late).alias("u")
    on = (F.col("r.path") == F.col("u.path")) & (F.col("u.at") >= F.col("r.at")) & (F.col("u.at") <= F.col("r.at") + F.expr(f"interval {wait}"))
    return r.join(u, on, "leftOuter").select(F.col("r.req_id"), F.col("r.path").alias("path"), F.col("u.at").alias("answered_at"))


def debounced(events: DataFrame, delay: int) -> DataFrame:
    """Events (path, seq, at) that schedule a run: none is pending in their path. The pending run's due time is the state."""

    def run(key: tuple, batches: Iterator[Any], state: GroupState) -> Iterator[Any]:
        import pandas as pd

        due = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        keep = []
        for t in rows["at"].tolist():
            fresh = due is None or t >= due
            keep.append(fresh)
            due = t + delay if fresh else due
        state.update((due,))
        yield rows[keep]

    own = events.select("path", "seq", "at")
    return own.groupBy("path").applyInPandasWithState(run, own.schema, "due long", "append", "NoTimeout")
