"""Queries and candidates meet by exchange: neither side is sent to the driver to be broadcast."""

import numpy as np
from pyspark.sql import Row

from codeloom.llm import topk


def test_visits_are_not_broadcast(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    x = rnd.integers(-90, 90, (300, 5))
    monkeypatch.setattr(topk, "PIECE", 16)
    rows = [Row(vec_id=i, embedding=[float(c) for c in v]) for i, v in enumerate(x)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scale=1)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    for q in range(0, 300, 20):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -s) for s, i in want]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan


def test_components_fit_their_type():
    assert [topk.narrow(x) for x in (0, 126, 127, 32766, 32767, 2.0**31 - 2, 2.0**31)] == [np.int8, np.int8, np.int16, np.int16, np.int32, np.int32, np.int64]
