"""Quality rules with risk-controlled cutoffs.

Base counts are taken of every whole text. Beyond the fixed base rules, the ratios of the counts go into one
badness per document, a logistic score whose weights are fitted on a bounded sample of the labelled rows' first third.
Per stratum (language) quantiles of that third's bad and good documents propose cutoffs, the mildest first; the other
labelled rows certify them: a cutoff holds only if the exact (Clopper-Pearson) upper bound on the share of good
documents it rejects stays within RISK, at confidence 1 - DELTA / strata (Bonferroni). Cutoffs of a stratum are tested from
the mildest on and testing stops at the first failure, so that their order needs no further correction. Quantiles
and rejections are aggregates over all labelled rows.

A stratum whose labelled good rows are too few to certify anything (about ln(strata / DELTA) / RISK without a
rejection) is judged by the base rules alone. Null texts are empty: all counts zero, base_failed. A null language is a
stratum of its own, apart from the empty one. Repeated rows are judged one by one; a doc_id that several rows share
lends its label to each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, store, text_or_empty

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: False rejection of good documents per stratum, and the chance that the guarantee fails in any of them.
RISK, DELTA = 0.03, 0.05
#: Labelled rows that the weights are fitted on: those of the least hash of doc_id.
MAX_LABELS = 40_000
#: Quantiles of the proposing part's bad and good documents; percentile_approx has one row in ACCURACY of error.
BAD_QUANTILES, ACCURACY = (0.9, 0.75, 0.5, 0.25, 0.1), 10_000
QUANTILES = (1.0, 0.998, 0.996, 0.994, 0.992, 0.99, 0.988, 0.986, 0.984, 0.982, 0.98, 0.978, 0.976, 0.974, 0.972, 0.97)
RULES = ("symbols", "repeats", "dup_lines", "odd_words")
#: Usual mean length of a word in code points, from which odd_words measures (as a log ratio).
USUAL_LENGTH = 5.5
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(mixed)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    at = np.flatnonzero(again[np.minimum(np.searchsorted(again, mixed), len(again) - 1)] == mixed)
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():  # equal hashes are compared as words
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for where in seen.values():
        if len(where) > 1:
            np.add.at(edge, where, 1)
            np.add.at(edge, np.array(where) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def count(text: str) -> tuple[int, int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the counts of each text. ``keep`` must not name a count."""
    own = docs.select(*keep, text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([count(t) for t in b.column(len(keep)).to_pylist()], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], *[pa.array(got[:, i]) for i in range(6)]], names=[*keep, *[c.split()[0] for c in COUNTS.split(", ")]]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, ", ".join(x for x in (kinds, COUNTS) if x))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def scores() -> dict[str, Column]:
    """The higher, the worse; 0 for texts without words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    odd = F.when(F.col("n_words") > 0, F.abs(F.log(F.col("word_chars") / F.col("n_words") / USUAL_LENGTH))).otherwise(0.0)
    return dict(zip(RULES, (per("n_symbols", "n_words"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), odd), strict=True))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n has probability delta."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        # from the largest term down; the terms vanish long before 0 where k is large
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        total, i = 0.0, k
        while i >= 0 and term > total * 1e-17:
            total += term
            term *= i * (1 - p) / ((n - i + 1) * p)
            i -= 1
        return total

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > delta else (low, mid)
    return high


def fit(x: np.ndarray, bad: np.ndarray) -> list[float]:
    """Weights (intercept first) of a logistic score by Newton steps with a ridge; no weight is below zero, so that more of a fault is never better."""
    free = list(range(x.shape[1]))
    w = np.zeros(x.shape[1] + 1)
    while True:
        design, v = np.column_stack([np.ones(len(x)), x[:, free]]), np.zeros(len(free) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ v, -40, 40)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(v)), design.T @ (bad - p) - 0.1 * v)
            v += np.clip(step, -2, 2)
            if abs(step).max() < 1e-8:
                break
        if (v[1:] >= 0).all():
            w[[0, *[1 + i for i in free]]] = v
            return w.tolist()
        free = [f for f, y in zip(free, v[1:], strict=True) if y > 0]


def badness(weights: list[float]) -> Column:
    """The logistic score before its curve: the higher, the worse."""
    return sum((F.lit(w) * x for w, x in zip(weights[1:], scores().values(), strict=True)), F.lit(weights[0]))


def certify(strata: dict[str, dict], risk: float = RISK, delta: float = DELTA) -> dict[str, float]:
    """The strictest certified cutoff by stratum. A stratum has cuts (mildest first), n (certifying good rows), rejected (of them, by cut), and the shares
    of the proposing part's bad and good rows that each cut rejects."""
    level, out = delta / max(1, len(strata)), {}
    for name, own in sorted(strata.items()):
        for cut, k, bad, good in zip(own["cuts"], own["rejected"], own["bad"], own["good"], strict=False):  # a stratum without bad rows has fewer cuts
            if not own["n"] or upper_bound(k, own["n"], level) > risk:
                break
            if bad >= max(0.02, 5 * good):  # of use only where it catches bad documents clearly more often than good ones
                out[name] = cut
    return out


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def cutoffs(counted: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> tuple[list[float], dict[str, float]]:
    """(weights, cutoffs by stratum); ``counted`` has doc_id, lang and the counts. The weights are fitted on at most ``most`` rows, the rest looks at every label."""
    named = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    part = F.least(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)), F.lit(1)).cast("int")
    rules = [c.alias(n) for n, c in scores().items()]
    own = store(counted.join(named, "doc_id").where(~base_failed()).select(_stratum().alias("stratum"), part.alias("part"), "good", "doc_id", *[c.split()[0] for c in COUNTS.split(", ")]), "quality-labelled")
    sample = own.where("part = 0").orderBy(F.xxhash64("doc_id"), "doc_id", "good", *rules).limit(most).select("good", *rules).collect()
    good = np.array([r["good"] for r in sample], float)
    if not len(good) or good.min() == good.max():
        return [0.0] * (1 + len(RULES)), {}
    weights = fit(np.array([tuple(r)[1:] for r in sample], float), 1 - good)
    scored = own.withColumn("badness", badness(weights))
    quantiles = lambda good, at: F.coalesce(F.percentile_approx(F.when(F.col("good") == good, F.col("badness")), list(at), ACCURACY), F.array().cast("array<double>"))
    proposed = F.concat(quantiles(0, BAD_QUANTILES), quantiles(1, QUANTILES))
    cuts = scored.where("part = 0").groupBy("stratum").agg(F.reverse(F.array_sort(proposed)).alias("cuts"))
    above = lambda when, j: F.sum(F.when(when & (F.col("badness") > F.get("cuts", F.lit(j))), 1).otherwise(0))
    count = lambda part, good: F.sum(F.when((F.col("part") == part) & (F.col("good") == good), 1).otherwise(0))
    kinds = {"rejected": (1, 1), "good": (0, 1), "bad": (0, 0)}
    sums = [F.array(*[above((F.col("part") == p) & (F.col("good") == g), j) for j in range(len(BAD_QUANTILES) + len(QUANTILES))]).alias(n) for n, (p, g) in kinds.items()]
    rows = scored.join(cuts, "stratum").groupBy("stratum").agg(F.first("cuts").alias("cuts"), *sums, *[count(p, g).alias(f"n_{n}") for n, (p, g) in kinds.items()]).collect()  # one row a language
    strata = {r["stratum"]: {"cuts": r["cuts"], "n": r["n_rejected"], "rejected": r["rejected"], **{k: [x / max(1, r[f"n_{k}"]) for x in r[k]] for k in ("good", "bad")}} for r in rows}
    return weights, certify(strata)


def rejected(fitted: tuple[list[float], dict[str, float]]) -> Column:
    """Whether the badness lies above the cutoff of the row's stratum."""
    weights, cuts = fitted
    out = F.lit(False)
    for name, cut in cuts.items():
        out = out | ((_stratum() == name) & (badness(weights) > cut))
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = store(counts(own, "doc_id", "lang"), "quality")
    cuts = cutoffs(rows, labels)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~rejected(cuts)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, its columns unchanged. The verdict follows from the row, so texts are not
    moved; they are counted twice, once for the cutoffs, which are those of `judge`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    cuts = cutoffs(store(counts(own, "doc_id", "lang"), "quality"), labels)
    names = docs.columns
    hidden = [f"c{i}" for i in range(len(names))]  # any column names, clashing ones too, pass through
    plain = docs.toDF(*hidden)
    text, lang = plain[hidden[names.index("text")]], plain[hidden[names.index("lang")]].cast("string").alias("lang")
    counted = counts(plain.select(*hidden, lang, text.alias("text")), *hidden, "lang")
    return counted.where(~base_failed() & ~rejected(cuts)).select(*hidden).toDF(*names)
