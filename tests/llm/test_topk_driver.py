"""What the search sends to the driver."""

import numpy as np
from pyspark.sql import Row

from codeloom.llm import topk


def test_one_blob_reaches_the_driver(spark, monkeypatch):
    """The blob of the longest vectors is fetched alone, however many tasks hold blobs; the ranking is that of brute force."""
    rnd = np.random.default_rng(4)
    x = rnd.integers(-50, 50, (400, 6))
    monkeypatch.setattr(topk, "PIECE", 16)
    sent, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: sent.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or collect(df))
    rows = [Row(vec_id=i, embedding=[float(c) for c in v]) for i, v in enumerate(x)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8), scale=1)
    assert not [p for c, p in sent if "m" in c and "TakeOrdered" in p]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    for q in range(0, 400, 20):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -s) for s, i in want]
