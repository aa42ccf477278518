"""The operators against brute force and the libraries, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import lmscore, packing, quality, sentencepiece_bpe, sharding, simhash, suffixdedup, topk, toxicity
from codeloom.llm.common import store, tokenizer_path

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "a b c d e f g"), (None, "no id here at all"), (6, "Ünïcode ﬁne 中文 😀 <|endoftext|> x"),
    (7, "again and " * 400), (8, "İ́ \xa0 \x85 \x1c ss ſ"), (9, "x" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", "mine") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def read(spark, sf, t="documents"):
    return spark.read.parquet(f"{sf}/{t}.parquet")


# --- op1


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [(i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
        got = Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[doc])
        assert all(got[c] for c in cut), doc
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_packing(spark, sf, odd, docs):
    rows = packing.pack_documents(read(spark, sf)).collect()
    n = check_packing(rows, docs)
    assert n == -(-sum(r["length"] for r in rows) // 2048)
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, ODD)
    assert packing.pack_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(3, 20, 9).tolist()

    def least(left, bins):
        if not left:
            return len(bins)
        out = 99
        for i in {b: k for k, b in enumerate(bins)}.values():
            if bins[i] + left[0] <= 20:
                out = min(out, least(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]]))
        return min(out, least(left[1:], [*bins, left[0]]))

    got = packing.solve(dict(Counter(sizes)), 20)
    used = Counter()
    for pattern, n in got:
        assert sum(pattern) <= 20
        for s in pattern:
            used[s] += n
    assert used == Counter(sizes)
    assert sum(n for _, n in got) == least(sorted(sizes, reverse=True), [])


# --- op2


def test_sentencepiece(spark, sf, odd, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for frame, texts in ((read(spark, sf), docs), (odd, ODD)):
        got = Counter(tuple(r) for r in sentencepiece_bpe.digests(frame).collect())
        want = Counter()
        for d, t in texts:
            ids = lib.encode(t or "", add_eos=True)
            want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
        assert got == want
    m = sentencepiece_bpe.model(tokenizer_path("piece_bpe_32k.model"))
    for _, t in ODD:
        ids = m.encode([t or ""])[0]
        assert m.decode(ids) == lib.decode(ids)
    assert sentencepiece_bpe.encode(odd).where("doc_id = 2").first()["ids"] == [lib.eos_id()]


# --- op3


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 24, 700])
def test_sharding(spark, sf, odd, shards):
    for frame in (read(spark, sf), odd):
        rows = sharding.assign(frame, shards).collect()
        slots = {}
        for r in rows:
            if r["doc_id"] is not None:
                key = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
                assert (r["shard"], r["grown_shard"]) == (jump(key, shards), jump(key, shards + 1))
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert got == {(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ODD}
    assert sharding.assign(odd.limit(0)).count() == 0


# --- op4


def test_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        v = rng.integers(-4, 5, 12).astype(float)

        def split(a, b):  # the best segment (shortest among equals), then what lies on either side of it
            best = max(((v[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if not best or best[0] <= 0:
                return []
            return [*split(a, best[3]), (best[3], best[4], best[0]), *split(best[4], b)]

        assert sorted(x[2] for x in toxicity.segments(v)) == sorted(x[2] for x in split(0, 12))


def test_toxicity(spark, sf, odd):
    docs, labels = read(spark, sf.replace("0.001", "0.01")), read(spark, sf.replace("0.001", "0.01"), "labels")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out")
    rows = got.select("toxic", "predicted", "score").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    bad = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(bad) >= 0.5 * len(bad)
    rows = toxicity.score(odd, labels.limit(0)).collect()
    assert len(rows) == len(ODD)
    assert {r["predicted"] for r in rows} == {0}
    assert toxicity.score(odd.limit(0), labels).count() == 0


# --- op5


def brute_scores(texts, order=3, a=0.4):
    words = [(t or "").encode().split() for _, t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in words]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    n = sum(map(len, words))
    out = []
    for w, g in zip(words, grams):
        other = lambda x: total[len(x) - 1][x] - g[len(x) - 1][x]  # noqa: E731, B023
        s = 0.0
        for i in range(len(w)):
            f = 1.0
            for k in range(min(order, i + 1), 1, -1):
                x = tuple(w[i - k + 1 : i + 1])
                if other(x) > 0:
                    s += math.log(f * other(x) / other(x[:-1]))
                    break
                f *= a
            else:
                s += math.log(f * (other((w[i],)) or a) / max(1, n - len(w)))
        out.append((len(w), round(s, 6)))
    return out


def test_lm_scores(spark, sf, odd, docs):
    got = {r["doc_id"]: (r["n_words"], round(r["log_score"], 6)) for r in lmscore.score(read(spark, sf)).collect()}
    want = dict(zip((d for d, _ in docs), brute_scores(docs)))
    assert all(got[d][0] == w[0] and math.isclose(got[d][1], w[1], rel_tol=1e-9, abs_tol=1e-5) for d, w in want.items())
    got = sorted((r["n_words"], round(r["log_score"], 6)) for r in lmscore.score(odd).collect())
    assert got == sorted(brute_scores(ODD))
    assert lmscore.score(odd.limit(0)).count() == 0


# --- op6


def test_covering_masks_cover():
    from itertools import combinations

    rng = np.random.default_rng(0)
    own = simhash.masks(4)
    assert len(own) == 31
    for bits in [rng.choice(64, 4, replace=False) for _ in range(2000)] + [list(c) for c in combinations(range(12), 4)]:
        x = sum(1 << int(b) for b in bits)
        assert any(m & x == 0 for m in own)


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, sf, odd, docs):
    near = [(1000 + i, f"{docs[7][1]} extra{i % 40} word") for i in range(90)]
    frame = spark.createDataFrame(docs + near + ODD, "doc_id long, text string")
    rows = simhash.near_duplicates(frame).collect()
    prints = [int(r["fingerprint"], 16) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, k in zip(rows, roots):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [least.get(k) for k in roots]
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}[2] == 0
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}[4] == xxhash.xxh64_intdigest(b"one", 42)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_buckets_cut_into_blocks_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(300)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(frame, block=40).collect()}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        root[find(a)] = find(b)
    want = brute_components(prints)
    assert len({find(p) for p in prints}) == len(set(want))


def near_copies(seed=11):
    """(texts, copies): originals, and edited copies with the number of words that were replaced in each."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    texts, copies = [], []
    for i in range(120):
        own = [word() for _ in range(int(rng.choice([60, 120, 300, 1000])))]
        near = list(own)
        for at in rng.choice(len(own), max(1, len(own) // int(rng.choice([55, 100]))), replace=False):
            near[int(at)] = word()
        texts.append(" ".join(own))
        copies.append(" ".join(near))
    return texts, copies


def test_keep_one_drops_near_copies(spark):
    texts, copies = near_copies()
    jaccard = lambda a, b: len(a & b) / len(a | b)
    far = [i for i, (a, b) in enumerate(zip(texts, copies, strict=True)) if jaccard(simhash.shingles(a, 5), simhash.shingles(b, 5)) < 0.8]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, t, "x") for i, t in enumerate(copies)] + [(2000, texts[0], "y"), (2000, texts[0], "y"), (None, texts[0], "z"), (3000, None, "n"), (3001, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_node string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = Counter(r["doc_id"] for r in got.collect())
    assert set(range(120)) <= set(kept) and kept[2000] == 0 and kept[None] == 1 and kept[3000] == 1 and kept[3001] == 0
    assert all(kept[1000 + i] for i in far)
    close = 120 - len(far)
    assert close >= 60 and sum(kept[1000 + i] for i in range(120)) - len(far) <= 0.1 * close


def test_keep_one_against_brute_force(spark, sf, docs):
    docs = docs + [(1000 + i, f"{docs[7][1]} extra{i % 40} word") for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {d: simhash.shingles(t or "", 5) for d, t in docs}
    prints = {d: simhash.word_fingerprint(t or "") for d, t in docs}
    group = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.STAGE_RADIUS and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert {r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()} == set(group.values())


# --- op7


def brute_removed(texts, n=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = [x for x in bytes(gone).split(b"\0") if x]
        out.append((len(r), sum(gone), len(runs), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_dedup(spark, odd, docs, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "RUN", 500)
    rng = np.random.default_rng(5)
    passage = docs[3][1][:700]
    texts = docs[:60] + [(500 + i, "".join(rng.choice(list("abcé "), int(rng.integers(0, 300)))) + passage[int(rng.integers(0, 300)) :][: int(rng.integers(150, 400))] + "z" * int(i % 5)) for i in range(70)]
    texts += ODD + [(900, "ab" * 300), (901, "ab" * 90), (902, docs[3][1])]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    own = suffixdedup.repeated_spans
    monkeypatch.setattr(suffixdedup, "repeated_spans", lambda t, length, gram: own(t, length, gram, hot))
    got = Counter(tuple(r) for r in suffixdedup.report(frame).collect())
    assert got == Counter((d, *w) for (d, _), w in zip(texts, brute_removed([t for _, t in texts])))
    assert suffixdedup.report(odd.limit(0)).count() == 0


def test_large_blocks_agree_with_pairs():
    rng = np.random.default_rng(9)
    left = [bytes(rng.choice(list(b"ab"), int(rng.integers(0, 9))).tolist()) for _ in range(300)]
    right = [bytes(rng.choice(list(b"ab"), int(rng.integers(12, 17)), p=[0.9, 0.1]).tolist()) for _ in range(300)]
    own = sorted(set(zip(right, left)))
    rights, lefts = [r for r, _ in own], [x for _, x in own]
    shared = suffixdedup.adjacent(rights)
    got = suffixdedup.block_extents(lefts, rights, shared, [1] * len(own), 8, 16)
    for i, (ml, mr) in enumerate(got):
        pairs = [(suffixdedup.common(lefts[i], lefts[j], 0), suffixdedup.common(rights[i], rights[j], 0)) for j in range(len(own)) if j != i]
        good = [p for p in pairs if sum(p) >= 16]
        assert (ml, mr) == (max((p[0] for p in good), default=0), max((p[1] for p in good), default=0))


def test_merge_is_sorted_with_true_prefixes():
    rng = np.random.default_rng(2)
    runs, everything = [], []
    for _ in range(7):
        keys = {bytes(rng.choice(list(b"ab"), int(rng.integers(1, 9))).tolist()) + suffixdedup.END for _ in range(40)}
        everything += keys
        runs.append(suffixdedup.Run(suffixdedup.write_run({k: [(0, 1)] for k in keys}, [(1, 2)])))
    got = list(suffixdedup.merge(runs))
    assert [k for k, _, _ in got] == sorted(everything)
    assert [n for _, n, _ in got][1:] == suffixdedup.adjacent([k for k, _, _ in got])[1:]


# --- op8


def brute_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by regular expressions and sets."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def test_quality(spark, sf, odd):
    docs, labels = read(spark, sf), read(spark, sf, "labels")
    got = quality.judge(docs, labels)
    assert got.count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == got.where("kept").count()
    rows = quality.judge(odd, labels).where("doc_id = 7").collect()
    assert (rows[0]["n_words"], rows[0]["n_repeat_words"], rows[0]["base_failed"], rows[0]["kept"]) == (800, 800, True, False)
    assert quality.judge(odd.limit(0), labels).count() == 0


def test_quality_counts_against_brute_force(spark, sf, docs, odd):
    labels = read(spark, sf, "labels")
    more = [(100 + i, x) for i, x in enumerate(["a\n a\na\n\n \n\n#<x>", "\x1c\x85 \xa0w | | |", "l\r\nl\r\n" * 30, "one two three four five six seven eight " * 3])]
    df = spark.createDataFrame([(d, t, None) for d, t in docs + ODD + more], "doc_id long, text string, lang string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = Counter((r["doc_id"], *[r[n] for n in names]) for r in quality.judge(df, labels).collect())
    assert got == Counter((d, *brute_quality(t)) for d, t in docs + ODD + more)


def test_quality_cutoffs_act_and_reject_few_good(spark):
    """Fitted on half of the labels, held against the other half."""
    big = "/root/testdata/sf0.1"
    docs, labels = read(spark, big), read(spark, big, "labels")
    rows = store(quality.counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), "doc_id", "lang"), "test-quality")
    fitted = quality.cutoffs(rows, labels.where("doc_id % 2 = 0"))
    assert "=en" in fitted[1]
    unseen = rows.join(labels.where("doc_id % 2 = 1"), "doc_id").where(~quality.base_failed()).withColumn("gone", quality.rejected(fitted))
    share = {(r["lang"], r["quality"]): r["share"] for r in unseen.groupBy("lang", "quality").agg(F.avg(F.col("gone").cast("int")).alias("share")).collect()}
    for name in fitted[1]:
        assert share[name[1:], 1] <= 0.04
        assert share[name[1:], 0] >= 0.6
    assert {"=en", "=de", "=fr"} <= set(quality.cutoffs(rows, labels)[1])
    assert quality.cutoffs(rows, labels.limit(0)) == ([0.0] * 5, {})


def test_strata_of_null_and_empty_language(spark):
    mark = lambda i: "#|" if i % 10 in (0, 3) else ""
    rows = [(i, None if i % 2 else "", " ".join(f"word{k}{i}{mark(i)}" for k in range(30))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    gone = {r["doc_id"] for r in quality.judge(docs, labels).where("not kept").collect()}
    # with the null language symbols are no sign of bad quality, with the empty one they always are
    assert {i for i in gone if i % 2} == set()
    assert {i for i in gone if not i % 2} == {i for i in range(0, 1200, 10)}


def test_repeat_words_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        w = [bytes([97 + int(x)]) for x in rng.integers(0, 2, 60)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(53))
        gone = {i + k for i in range(53) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert quality.repeat_words(w) == len(gone)


def test_binomial_bound():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    p = quality.upper_bound(3, 50, 0.01)
    assert abs(sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) - 0.01) < 1e-9


def test_certified_cutoffs():
    own = {"cuts": [0.9, 0.5, 0.1], "n": 1000, "rejected": [0, 10, 200], "bad": [0.0, 0.5, 0.9], "good": [0.0, 0.01, 0.2]}
    assert quality.certify({"en": own}) == {"en": 0.5}
    assert quality.certify({"en": own | {"n": 90, "rejected": [0, 0, 0]}}) == {}
    assert quality.certify({"en": own | {"rejected": [40, 0, 0]}}) == {}  # testing stops at the first failure


def test_weights_are_never_negative():
    rng = np.random.default_rng(8)
    x = rng.random((2000, 3))
    w = quality.fit(x, (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(2000) > 0.4).astype(float))
    assert w[1] > 1 and w[2] == 0 and w[3] >= 0


# --- op10


def test_topk_many_blocks(spark, monkeypatch):
    """Norms of three scales in many blocks and salted shares, a third of the rows one vector, repeated ids, one vector longer than what is rotated."""
    monkeypatch.setattr(topk, "PIECE", 30)
    monkeypatch.setattr(topk, "BLOCKS", 8)
    monkeypatch.setattr(topk, "ROTATED", 12)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * 10.0 ** (i % 3)).tolist()) for i in range(1, 700)]
    rows += [(i, rows[7][1]) for i in range(700, 1050)] + [(60, rows[3][1]), (1100, rng.normal(size=40).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(frame, k=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    m = np.zeros((len(rows), 40), np.int64)
    for k, (_, v) in enumerate(rows):
        m[k, : len(v)] = np.floor(64 * np.array(v))
    ids = np.array([i for i, _ in rows])
    want = {}
    for q in {int(i) for i in ids if i % 20 == 0}:
        pairs = [(int(i), int(s)) for at in np.flatnonzero(ids == q) for i, s in zip(ids, m @ m[at], strict=True) if i != q]
        want[q] = sorted(pairs, key=lambda x: (-x[1], x[0]))[:7]
    assert dict(got) == want


def test_topk(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    rows += [(10_000, None), (10_020, [None, 1.0]), (10_040, [float("nan")] * 64), (10_060, rows[0][1]), (10_060, rows[0][1]), (10_080, [0.5]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(frame).orderBy("query_id", "rank").collect()]
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in good])
    m = np.zeros((len(good), 64), np.int64)
    for k, (_, v) in enumerate(good):
        m[k, : len(v)] = np.floor(64 * np.array(v, float))
    want = []
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        owns = np.flatnonzero(ids == q)
        best = Counter()
        for at in owns:
            s = m @ m[at]
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
            best.update({(int(ids[k]), int(s[k]), int(at), j): 1 for j, k in enumerate(order)})
        if len(owns) == 1:
            want += [(q, j + 1, i, s) for i, s, _, j in sorted(best, key=lambda x: x[3])]
    assert [g for g in got if g[0] != 10_060] == want
    assert topk.top_k(frame.limit(0)).count() == 0


# --- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf)
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == names, name
        assert after.schema == docs.schema or [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        assert 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in before.collect()])


def test_stored_tables_can_be_cleaned(spark):
    import os

    from codeloom.llm import common

    df = common.store(spark.range(3).toDF("x"), "probe")
    assert df.count() == 3
    folder = common.shared_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    common.clean(spark)
    assert not os.path.isdir(folder)
