"""Near-dedup of texts with the same words: only those that share shingles are compared."""

import random

from codeloom.llm import simhash


def test_texts_of_the_same_words_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(20))
    texts += [f"{passage} {' '.join(rng.sample(words, 60))}" for _ in range(150)]
    copies = [f"{t} end" for t in texts[::10]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    compared = []
    alike = simhash._alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(simhash, "_alike", counted)
    assert {r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()} == set(range(300))
    assert 30 <= sum(compared) <= 60, compared


def test_prefixes_of_links_meet():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    met = 0
    for n in [1, 2, 4, 5, 6, 9, 12, 30, 100] * 20:
        a = [rng.choice(words) for _ in range(n)]
        b = list(a)
        b[rng.randrange(n)] = "x"
        for x, y in ((a, a), (a, b), (a, [*a, "end"])):
            x, y = " ".join(x), " ".join(y)
            hx, hy = simhash.shingle_hashes(x, 5), simhash.shingle_hashes(y, 5)
            sx, sy = simhash.shingles(x, 5), simhash.shingles(y, 5)
            assert len(hx) == len(sx) and len(set(hx.tolist()) & set(hy.tolist())) == len(sx & sy)
            for last in (hx[:0], hx[: len(hx) // 2], hy):
                px, py = (simhash.prefix(h, last, 0.8).tolist() for h in (hx, hy))
                if len(sx & sy) >= 0.8 * len(sx | sy):
                    met += 1
                    assert set(px) & set(py)
    assert met > 500
