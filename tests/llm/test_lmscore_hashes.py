"""Hashes of the language model."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import lmscore


def test_hashes_have_64_bits_at_every_size():
    words = lmscore.word_hashes([b"w%d" % i for i in range(200)])
    assert lmscore.ngram_hashes(words, np.zeros(200, np.int64), 3).max() >= np.uint64(1 << 63)


def test_unseen_context_is_backed_off_from():
    assert lmscore.known(np.array([1, 2, 3, 0]), np.array([0, 5, 1, 1])).tolist() == [False, False, True, False]


def test_only_trigrams_that_can_recur_are_asked_for(spark, monkeypatch):
    """Of the texts' trigrams only the shared ones, whose parts occur in other documents, travel."""
    asked = Counter()

    def seen(keep):
        def run(df, name):
            out = keep(df, name)
            if name == "lm-answers":
                for r in out.select(F.explode(out.columns[-1]).alias("x")).select("x.*").collect():
                    asked[r["n"]] += len(zlib.decompress(r["totals"])) // 8
            return out

        return run

    for name in ("store", "result"):
        if hasattr(lmscore, name):
            monkeypatch.setattr(lmscore, name, seen(getattr(lmscore, name)))
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) + " a b c d" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["log_score"] for r in lmscore.score(df).collect()}
    assert len({round(x, 9) for x in got}) == 1
    assert asked[1] >= 1004 and 2 <= asked[3] <= 2 * 20, asked
