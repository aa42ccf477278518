"""What the operators share: reading inputs, shared storage, row keys and Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of every operator here: bytes.split() and this class agree.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, by Spark's own reader, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/codeloom-{sc.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application's operators have stored; results that are still to be read need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    passing(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths and catalog tables that the open `steps` have written, the innermost last.
_STEPS: list[list[tuple[str, str | None]]] = []


def passing(path: str, table: str | None = None) -> None:
    """Let the innermost `steps`, if any, delete the path and drop the table at its end."""
    if _STEPS:
        _STEPS[-1].append((path, table))


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, and the shuffle files of its plans are let go. A result must be stored outside, or by `result`."""
    _STEPS.append([])
    try:
        yield
    finally:
        for path, table in _STEPS.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for _ in range(2):  # the driver drops shuffle files when their plans are collected; the first collection alone leaves them
            gc.collect()
            spark._jvm.System.gc()


def result(df: DataFrame, name: str) -> DataFrame:
    """`store` for what outlives the innermost `steps`; it belongs to those around them, if any."""
    own = _STEPS.pop()
    try:
        return store(df, name)
    finally:
        _STEPS.append(own)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with no column of ``df`` (Spark resolves names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut smaller, so that few long texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; CODELOOM_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("CODELOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
