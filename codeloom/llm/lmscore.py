"""Stupid-backoff language-model scores, each document scored by all the others.

Documents are packed into chunks of bounded size. A chunk sends each distinct n-gram once, as sorted 64-bit hashes cut
by hash range, to the partition that keeps the counts of that range; the partition adds up all chunks and
answers each with the totals of its n-grams, in the same order. Back in the chunk, totals less the document's
own counts give the score of each word: the highest order whose n-gram occurs elsewhere, over the count of
its context, with a factor BACKOFF for each order passed over. Sums of logarithms per document are the result.

The highest order is asked for last, and only n-grams both of whose parts (all words but the first, all but the
last) occur in other documents: no other n-gram can, so no count changes. What was exchanged for the lower
orders is let go before.

Frequent n-grams are added up in the chunk before they travel, so no key gathers in one place. Null texts are
empty: no words, score 0. Repeated rows are documents of their own and see one another. A word that no other
document has counts as BACKOFF of one occurrence. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, result, slices, steps, store, text_or_empty

ORDER, BACKOFF = 3, 0.4
#: Words of a chunk, distinct n-grams of a partition on average, distinct words a worker remembers.
CHUNK, PART, MEMO = 1_200_000, 3_000_000, 300_000
#: Bits of a hash, at every size of the input.
BITS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
_MEMO: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    memo, digest = _MEMO, xxhash.xxh3_64_intdigest
    for w in set(words):
        if w not in memo:
            memo[w] = digest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, first: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """The hash of the n-gram that ends at each word; of as many words as the document has up to there, at most `order`."""
    h = words.copy()
    n = len(words)
    back = np.arange(n) - first  # words of the document before this one
    with np.errstate(over="ignore"):
        for k in range(1, order):
            at = np.flatnonzero(back >= k)
            h[at] = (h[at] ^ (words[at - k] + np.uint64(k) * MIX)) * MIX
            h[at] ^= h[at] >> np.uint64(31)
        h = (h ^ (h >> np.uint64(33))) * MIX
    return h >> np.uint64(64 - bits)


def known(ngrams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Whether the n-gram that ends at a word and its context, which ends a word earlier, occur elsewhere; hashes that collide may give only one of them."""
    before = np.zeros(len(contexts), contexts.dtype)
    before[1:] = contexts[:-1]
    return (ngrams > 0) & (before > 0)


def places(at_word: np.ndarray, order: int, below: np.ndarray | None = None) -> np.ndarray:
    """The words at which a whole n-gram ends; if the occurrences elsewhere of the order below are given, only n-grams both of whose parts have some."""
    whole = at_word >= order - 1
    return np.flatnonzero(whole if below is None else whole & known(below, below))


def elsewhere(ngrams: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Occurrences of each n-gram in other documents than its own; totals: of the distinct ones, ascending."""
    own, at = np.unique(ngrams, return_inverse=True)
    _, mine, times = np.unique(doc * np.int64(max(1, len(own))) + at, return_inverse=True, return_counts=True)
    return totals[at] - times[mine]


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, docs (ids), words (of each), vocab (hashes of the distinct words, frequent ones first), places (each word's in vocab, compressed): whole documents, at most about `size` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, hashes, total, number = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            own, at, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")
            rank = np.empty(len(by), "<u4")
            rank[by] = np.arange(len(by))
            raw = zstandard.compress(np.ascontiguousarray(rank[at].view(np.uint8).reshape(-1, 4).T).tobytes(), 3)
            cols = [pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([own[by].astype("<u8").tobytes()], pa.binary()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "docs", "words", "vocab", "places"])

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = text.encode("utf-8", "surrogatepass").split()
                ids.append(doc), counts.append(len(own)), hashes.append(word_hashes(own))
                total += len(own)
                if total >= size:
                    yield out()
                    ids, counts, hashes, total, number = [], [], [], 0, number + 1
        if ids:
            yield out()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return own.mapInArrow(run, "chunk long, docs array<long>, words array<long>, vocab binary, places binary")


def _positions(counts: list[int], vocab: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and for each word its document and that document's first word."""
    at = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    n = np.array(counts, np.int64)
    starts = np.cumsum(n) - n
    return np.frombuffer(vocab, "<u8")[at], np.repeat(np.arange(len(n)), n), np.repeat(starts, n)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that the high bytes compress."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _widen(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(x: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _squeeze(np.diff(x, prepend=np.uint64(0)))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_widen(raw), dtype=np.uint64)


def _others(words: np.ndarray, doc: np.ndarray, first: np.ndarray, told: list[dict] | None, upto: int, order: int) -> list[np.ndarray]:
    """For each order, of the n-gram that ends at each word: occurrences in other documents."""
    out: list[np.ndarray] = []
    for k in range(1, upto + 1):
        totals = [_widen(a["totals"]).view("<i8") for a in told or () if a["n"] == k]
        at = places(np.arange(len(words)) - first, k, out[-1] if k == order > 1 else None)
        out.append(np.zeros(len(words), np.int64))
        out[-1][at] = elsewhere(ngram_hashes(words, first, k)[at], doc[at], np.concatenate(totals) if totals else np.empty(0, np.int64))
    return out


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms) and mean_log_score of every row."""
    spark = docs.sparkSession
    with steps(spark):
        held = store(chunks(docs).withColumn("told", F.array().cast("array<struct<n:int,part:int,totals:binary>>")), "lm-chunks")
        total = held.select(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = max(partitions(spark), -(-order * total // PART))
        held = result(_answered(held, range(1, order), order, parts), "lm-chunks")
    met = _answered(held, [order], order, parts).select("docs", "words", "vocab", "places", "told")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, counts, vocab, blob, told in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                words, doc, first = _positions(counts, vocab, blob)
                n = len(words)
                others = _others(words, doc, first, told, order, order)
                length = np.array(counts, np.int64)
                log = np.zeros(n)
                open_ = np.ones(n, bool)
                back_by = np.zeros(n)
                at_word = np.arange(n) - first
                for k in range(order, 1, -1):
                    has = open_ & (at_word >= k - 1)
                    hit = np.flatnonzero(has & known(others[k - 1], others[k - 2]))
                    log[hit] = back_by[hit] + np.log(others[k - 1][hit]) - np.log(others[k - 2][hit - 1])
                    open_[hit] = False
                    back_by[has & open_] += np.log(backoff)
                rest = np.flatnonzero(open_)
                seen = np.where(others[0][rest] > 0, others[0][rest], backoff) if n else np.empty(0)
                log[rest] = back_by[rest] + np.log(seen) - np.log(np.maximum(1, total - length[doc[rest]]))
                sums = np.bincount(doc, log, len(ids)) if n else np.zeros(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums), pa.array(sums / np.maximum(1, length))],
                    names=["doc_id", "n_words", "log_score", "mean_log_score"],
                )

    return met.mapInArrow(back, "doc_id long, n_words long, log_score double, mean_log_score double")


def _answered(held: DataFrame, orders: Iterable[int], order: int, parts: int) -> DataFrame:
    """The chunks, to whose answers those for the n-grams of these orders are added. The answers are stored, what was exchanged for them is let go."""
    edges = (np.arange(1, parts, dtype=object) * (1 << BITS) // parts).astype(np.uint64)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, counts, vocab, blob, told in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                words, doc, first = _positions(counts, vocab, blob)
                for k in orders:
                    below = _others(words, doc, first, told, k - 1, order)[-1] if k == order > 1 else None
                    at = places(np.arange(len(words)) - first, k, below)
                    own, n = np.unique(ngram_hashes(words, first, k)[at], return_counts=True)
                    cut = [0, *np.searchsorted(own, edges).tolist(), len(own)]
                    some = [p for p in range(parts) if cut[p] < cut[p + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int32()), pa.array([k] * len(some), pa.int32()), pa.array([chunk] * len(some), pa.int64()),
                            pa.array([_pack(own[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                            pa.array([zlib.compress(n[cut[p] : cut[p + 1]].astype("<u4").tobytes(), 1) for p in some], pa.binary()),
                        ],
                        names=["part", "n", "chunk", "hashes", "counts"],
                    )

    def add(table: pa.Table) -> pa.Table:
        """The count table of one range and order, looked up for every chunk that asked."""
        hashes = [_unpack(x) for x in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
        sizes = np.cumsum([len(h) for h in hashes])[:-1]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts)).astype("<i8")[at]
        own = [_squeeze(x) for x in np.split(totals, sizes)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "n": table.column("n"), "totals": pa.array(own, pa.binary())})

    with steps(held.sparkSession):
        asked = held.select("chunk", "words", "vocab", "places", "told").mapInArrow(explode, "part int, n int, chunk long, hashes binary, counts binary")
        answers = asked.groupBy("part", "n").applyInArrow(add, "chunk long, part int, n int, totals binary")
        # a chunk has one answer for each part and order it asked
        more = result(answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("n", "part", "totals"))).alias("more")), "lm-answers")
    own = [c for c in held.columns if c != "told"]
    return held.join(more, "chunk", "left").select(*own, F.when(F.col("more").isNull(), F.col("told")).otherwise(F.concat("told", "more")).alias("told"))
