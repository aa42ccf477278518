"""Toxicity by maximum-scoring segments of token log-odds.

Distinct training texts give document counts of words by label; log-odds with an informative Dirichlet prior
(the words' overall counts) and their z-scores make the token scores, shifted so that a clean text drifts down. A linear scan finds
all maximal segments of a text. A segment's score becomes an expected number of chance segments by the
extreme-value law (lambda from the clean word distribution, K from the clean training texts); the evidence
of the significant segments goes through a logistic curve fitted on the training rows.

Only text enters a score. Null and empty texts have no segment and get the curve's floor. Repeated rows are
scored one by one. Without training rows of both labels every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store, text_or_empty

#: Labelled rows used for training: those of the least hash of doc_id. They bound the words of the model, of which it keeps those that tell.
MAX_LABELS = 40_000
#: Weight of the prior in words, and the least that one word has of it; least log-odds and z of a word with a
#: score of its own; what every token loses.
PRIOR, LEAST_PRIOR, LEAST_ODDS, LEAST_Z, DRIFT = 500.0, 0.5, 2.5, 3.0, 0.25
#: Expected chance segments under which a segment is significant.
SIGNIFICANT = 0.05
THRESHOLD = 0.7
TOKENS = re.compile(r"\w+").findall


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 0.0
    floor: float = -50.0

    def probability(self, evidence: float) -> float:
        x = self.floor + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    The candidates are kept with the running total before and after each. A new one joins back to the nearest
    earlier candidate that starts lower, as long as it ends higher than that one does.
    """
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    total = np.cumsum(values)
    own: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, index of the nearest lower start
    for i in at.tolist():
        start, before, after = i, float(total[i] - values[i]), float(total[i])
        j = len(own) - 1
        while True:
            while j >= 0 and own[j][2] >= before:
                j = own[j][4]
            if j < 0 or own[j][3] >= after:
                own.append((start, i + 1, before, after, j))
                break
            start, before = own[j][0], own[j][2]
            low = own[j][4]
            del own[j:]
            j = low
    return [(s, e, after - before) for s, e, before, after, _ in own]


def token_scores(text: str, terms: dict[str, float]) -> np.ndarray:
    words = TOKENS(text.lower())
    get = terms.get
    return np.array([get(w, 0.0) for w in words], float) - DRIFT


def found(text: str, model: Model) -> tuple[int, list[float]]:
    """Number of tokens, and lambda * score - ln(tokens) of each segment where that is positive."""
    values = token_scores(text, model.terms)
    if not len(values):
        return 0, []
    log_n = math.log(len(values))
    return len(values), [z for _, _, s in segments(values) if (z := model.rate * s - log_n) > 0]


def passages(text: str, model: Model) -> list[tuple[int, int, float]]:
    """The significant segments of a text in tokens, with their expected number by chance."""
    values = token_scores(text, model.terms)
    own = [(s, e, model.scale * len(values) * math.exp(-model.rate * x)) for s, e, x in segments(values)]
    return [x for x in own if x[2] < SIGNIFICANT]


def evidence(found_z: list[float], scale: float) -> float:
    least = -math.log(SIGNIFICANT) + math.log(scale)
    return sum(z - math.log(scale) for z in found_z if z > least)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean over rows (text, toxic): documents that hold the word, counted in each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(own[0].keys() | own[1].keys())
            cols = [pa.array(words, pa.string()), *[pa.array([own[k][w] for w in words], pa.int64()) for k in (1, 0)]]
            own[0].clear(), own[1].clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "clean"])

        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own[label].update(set(TOKENS(text.lower())))
            if len(own[0]) + len(own[1]) > 300_000:
                yield out()
        yield out()

    return rows.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(terms: dict[str, float], clean: dict[str, int], total: int) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over the clean words."""
    values = [terms[w] - DRIFT for w in terms] + [-DRIFT]
    weights = [clean[w] + 0.5 for w in terms]
    weights.append(max(1.0, total - sum(weights)))
    v, p = np.array(values), np.array(weights) / sum(weights)
    low, high = 0.0, 1.0
    if (p * v).sum() >= 0 or v.max() <= 0:
        return 1.0
    while (p * np.exp(np.minimum(high * v, 600))).sum() < 1 and high < 60:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * v, 600))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak ridge."""
    w, design = np.zeros(2), np.column_stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(rows: DataFrame) -> Model:
    """Fit on stored rows (text, toxic in 0/1), bounded in number by the caller."""
    counted = store(word_counts(rows), "toxic-words")
    toxic, clean = counted.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not toxic or not clean:
        return Model()
    prior = F.greatest((F.col("toxic") + F.col("clean")) * (PRIOR / (toxic + clean)), F.lit(LEAST_PRIOR))
    odds = lambda n, total: F.log((F.col(n) + prior) / (F.lit(total + PRIOR) - F.col(n) - prior))
    scored = counted.select(
        "word", "clean", (odds("toxic", toxic) - odds("clean", clean)).alias("odds"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("sd")
    ).where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") >= LEAST_Z * F.col("sd")))
    kept = scored.orderBy("word").collect()  # bounded by the words of the training texts
    terms = {r["word"]: r["odds"] for r in kept}
    model = Model(terms, _rate(terms, {r["word"]: r["clean"] for r in kept}, clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [found(t, model) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["toxic", "n", "z"])

    got = rows.mapInArrow(run, "toxic int, n long, z array<double>").collect()
    null = [max(r["z"], default=0.0) for r in got if not r["toxic"] and r["n"]]
    if null:  # exp(-z) of the best chance segment is exponential with rate K; a text without one counts as z = 0
        model.scale = min(1.0, max(1e-6, len(null) / sum(math.exp(-z) for z in null)))
    x = np.log1p([evidence(r["z"], model.scale) for r in got])
    y = np.array([r["toxic"] for r in got], float)
    model.floor, model.slope = _logistic(x, y)
    if model.slope < 0:  # more evidence never makes a text less likely toxic
        model.floor, model.slope = _logistic(np.zeros_like(x), y)[0], 0.0
    return model


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels are read for training rows only."""
    named = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = named.where(fold() != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    model = train(store(own.join(F.broadcast(sample), "doc_id").select("text", "toxic").distinct(), "toxic-train"))  # bounded by `most`
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            own = [m.probability(evidence(found(t, m)[1], m.scale)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(own, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = own.select("doc_id", (fold() == 1).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
