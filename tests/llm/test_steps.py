"""Stored steps and their shuffle files."""

import time

from pyspark.sql import functions as F

from codeloom.llm import common


def test_shuffle_files_of_a_step_are_let_go(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffled()
    with common.steps(spark):
        kept = common.result(spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).agg(F.first("id").alias("id")), "kept")
        assert shuffled() - before
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 200_000
