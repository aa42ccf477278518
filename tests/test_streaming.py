"""Streams against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import delta
from codeloom.plans import adapters
from codeloom.streaming import updates as streaming


def source(spark, sf, tmp_path, parts=3):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = str(tmp_path / "events")
    for i in range(parts):  # files in order of the events, one for each batch
        events.where((F.col("event_id") * parts / (events.count() + 1)).cast("int") == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path), events


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_monotone_stamps(spark, sf, tmp_path):
    stream, events = source(spark, sf, tmp_path)
    got = run(streaming.accepted(adapters.updates(stream)), "accepted")
    want = delta.accepted(adapters.updates(events)).select("path", "seq", "ts", "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debounce(spark, sf, tmp_path):
    stream, events = source(spark, sf, tmp_path, parts=1)
    got = run(streaming.debounced(adapters.updates(stream), 3600), "debounced")
    want = delta.debounced(adapters.updates(events).select("path", "seq", "at"), 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_maintained_state(spark, sf, tmp_path):
    stream, events = source(spark, sf, tmp_path)
    change = lambda df: adapters.updates(df).select("path", "step", F.when(F.col("change") == "delete", -1).otherwise(1).alias("delta"))
    q = streaming.maintain(change(stream), str(tmp_path / "state"), ("path", "step"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert q.exception() is None
    last = spark.read.parquet(str(tmp_path / "state" / "v2"))
    assert last.count() > 0
    # a batch drops rows at or below zero, as the batch form does batch by batch
    state = None
    for i in range(3):
        own = change(events.where((F.col("event_id") * 3 / (events.count() + 1)).cast("int") == i)).groupBy("path", "step").agg(F.sum("delta").alias("delta"))
        state = delta.refcount(own, ("path", "step")) if state is None else delta.apply(state, own, ("path", "step"))
    assert sorted(map(tuple, last.select("path", "step", "refcnt").collect())) == sorted(map(tuple, state.select("path", "step", "refcnt").collect()))


def test_requests_wait_for_updates(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    spark.createDataFrame([(1, 7, at(0)), (2, 7, at(100)), (3, 8, at(0)), (4, 9, at(9000))], "req_id long, path long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(7, at(3)), (7, at(120)), (9, at(9000))], "path long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "u"))
    r = spark.readStream.schema("req_id long, path long, at timestamp").parquet(str(tmp_path / "r"))
    u = spark.readStream.schema("path long, at timestamp").parquet(str(tmp_path / "u"))
    got = {x["req_id"]: x["answered_at"] for x in run(streaming.answered(r, u), "answered").collect()}
    assert got[1] == at(3)
    assert got[4] == at(9000)
    assert got.get(2, None) is None
    assert got.get(3, None) is None


def test_open_documents(spark, tmp_path):
    from codeloom.streaming import documents

    rows = [
        ("a", 1, "open", None, None, None, None, "one\ntwo"), ("a", 2, "change", 1, 0, 1, 3, "2"), ("b", 3, "change", None, None, None, None, "never opened"),
        ("a", 4, "change", None, None, None, None, "all new"), ("a", 5, "close", None, None, None, None, None), ("a", 6, "change", 0, 0, 0, 0, "x"), ("a", 7, "open", None, None, None, None, "back"),
    ]
    events = spark.createDataFrame(rows, documents.EVENTS)
    want = [("a", 1, 0, "one\ntwo"), ("a", 2, 1, "one\n2"), ("a", 4, 2, "all new"), ("a", 7, 0, "back")]
    assert sorted(map(tuple, documents.replay(events).collect())) == want
    for i in range(3):
        events.where((F.col("seq") > i * 2) & (F.col("seq") <= (i * 2 + 2 if i < 2 else 99))).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(documents.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    assert sorted(map(tuple, run(documents.follow(stream), "followed").collect())) == want


def test_options(spark):
    from codeloom.options import Options

    o = Options(deny=["/test/"], allow=["keep"], path_mappings=["/a>/b"])
    row = spark.range(1).select(o.indexed(F.lit("/x/test/y")).alias("p"), o.indexed(F.lit("/x/test/keep")).alias("q"), o.mapped(F.lit("/a/c")).alias("m")).first()
    assert tuple(row) == (False, True, "/b/c")
