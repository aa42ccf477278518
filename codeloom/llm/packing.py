"""Best-fit packing by bin completion.

Documents are tokenised, cut where they exceed the capacity, and packed into as few sequences as the
search finds. Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver; the
search works on lengths with multiplicities, so its cost does not depend on the number of documents.

Null texts are empty; an empty text is one piece that holds only the end id. Repeated rows and
repeated doc_ids are packed one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, store, text_or_empty, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Search nodes, and fillings looked at around one document. They bound the search, not the data.
NODES = 20_000
FILLINGS = 48
#: Distinct parts of words whose ids a worker remembers.
MEMO = 300_000
#: Letters that have no decomposition to compose and lower-case letter by letter, digits and signs.
PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿŒœ‘’“”„–—…]+").fullmatch
#: The pre-tokeniser's pattern (a fixed value), over those characters in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\sa-zß-öø-ÿœ0-9]+").findall


# --- tokens -----------------------------------------------------------------------------------------


class WordTokens:
    """Ids of whole texts as little-endian uint32 bytes, with a memo of the ids of parts of words.

    The vocabulary's normaliser and pre-tokeniser never join characters across ASCII white space, so a
    text's ids are those of its words one after another. Words of plain letters, digits and signs are
    parted further, as the pre-tokeniser parts them, and the parts that are new go to the library in one
    string: each part ends with the one id that closes a word. Other words, and texts that may hold an
    added token's string, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 4000):
            own = parts[at : at + 4000]
            ids = np.asarray(self.tok.encode(" ".join(own), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(own):
                self.parts.update((p, self._whole(p)) for p in own)
                continue
            raw, at_byte = ids.tobytes(), 0
            for p, end in zip(own, (ends * 4).tolist(), strict=True):
                self.parts[p] = raw[at_byte:end]
                at_byte = end

    def _cut(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after another, are the text's."""
        if PLAIN(text):
            return PARTS(text.lower())
        out: list[str] = []
        for w in text.encode("utf-8", "surrogatepass").split():
            s = w.decode("utf-8", "surrogatepass")
            if PLAIN(s):
                out += PARTS(s.lower())
            else:
                if s not in self.parts:
                    self.parts[s] = self._whole(s)
                out.append(s)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > MEMO:
            self.parts.clear()
        cut = [[] if any(m in t for m in self.marks) else self._cut(t) for t in texts]
        known = self.parts
        self._learn_parts([p for p in set().union(*cut) if p not in known])
        return [b"".join(map(known.__getitem__, ps)) if ps else self._whole(t) for t, ps in zip(texts, cut, strict=True)]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that its memo serves all the tasks the worker runs."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, run int, place long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece. ``run`` is the task that made it and ``place`` its rank there among pieces of its length."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, run = word_tokens(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), tokens.ids(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for col, v in zip(out, (doc, k, at // 4, n, zlib.crc32(own), seen[n]), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*cols[:5], pa.array([run] * len(out[0]), pa.int32()), cols[5]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "run", "place"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


# --- search -----------------------------------------------------------------------------------------

Pattern = tuple[int, ...]


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on lengths with multiplicities: equal bins are kept as one group."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    gaps: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        if not n:
            return
        gap = capacity - sum(pattern)
        if gap not in open_bins:
            open_bins[gap] = []
            gaps.insert(bisect_left(gaps, gap), gap)
        open_bins[gap].append((pattern, n))

    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                put((size,) * each, left // each)
                put((size,) * (left % each), 1 if left % each else 0)
                break
            gap = gaps[at]
            pattern, n = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            each = gap // size
            full = min(n, left // each)
            put(pattern + (size,) * each, full)
            left -= full * each
            n -= full
            if n and left:  # fewer than `each` are left
                put(pattern + (size,) * left, 1)
                left, n = 0, n - 1
            put(pattern, n)
    return [g for own in open_bins.values() for g in own]


def dominated(filling: Pattern, gap: int, sizes: list[int], free: dict[int, int]) -> bool:
    """Whether one unused document could replace some of the filling without overflow, holding at least as much."""
    slack = gap - sum(filling)
    used: dict[int, int] = {}
    for s in filling:
        used[s] = used.get(s, 0) + 1
    most = len(filling) if len(filling) <= 6 else 2
    for k in range(0, most + 1):
        for own in set(combinations(filling, k)):
            t = sum(own)
            at = bisect_left(sizes, t + (k < 2))
            while at < len(sizes) and sizes[at] <= t + slack:
                if free[sizes[at]] > used.get(sizes[at], 0):
                    return True
                at += 1
    return False


def fillings(gap: int, sizes: list[int], free: dict[int, int], most: int) -> list[Pattern]:
    """Undominated ways to fill ``gap``, fullest first. ``sizes`` ascend; ``free`` counts what is left of each."""
    if gap and free.get(gap, 0):
        return [(gap,)]  # one document that fits exactly dominates all else
    found: list[Pattern] = []
    tries = [most * 8]

    def grow(own: list[int], left: int, top: int) -> None:
        at = bisect_right(sizes, min(left, top)) - 1
        any_fits = False
        while at >= 0 and tries[0] > 0 and len(found) < most:
            s = sizes[at]
            at -= 1
            if free[s] <= own.count(s):
                continue
            any_fits = True
            if left == s:
                found.append((*own, s))
                return
            if len(own) < 5 or not own:
                tries[0] -= 1
                grow([*own, s], left - s, s)
            else:  # long fillings go on greedily
                rest, gone = [*own], left
                for i in range(at + 1, -1, -1):
                    n = min(free[sizes[i]] - rest.count(sizes[i]), gone // sizes[i])
                    rest += [sizes[i]] * max(0, n)
                    gone -= sizes[i] * max(0, n)
                    if not gone:
                        break
                found.append(tuple(rest))
                return
        if not any_fits:
            found.append(tuple(own))

    grow([], gap, gap)
    keep = [f for f in dict.fromkeys(found) if not dominated(f, gap, sizes, free)] or [max(found, key=sum)]
    return sorted(keep, key=lambda f: (gap - sum(f), len(f)))


def solve(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = FILLINGS) -> list[tuple[Pattern, int]]:
    """Patterns with the number of bins of each; together they use every document of ``hist`` once.

    Bin completion: around the largest document left, each undominated filling is a branch, applied to
    as many bins at once as its documents allow. A branch goes no further once its waste exceeds what a
    solution better than the incumbent may waste. Best-fit decreasing gives the first incumbent.
    Each application exhausts some length or lowers its uses in a bin, so a solution has at most
    sum(capacity // s) patterns over the lengths s.
    """
    hist = {s: n for s, n in hist.items() if n}
    if not hist:
        return []
    if min(hist) < 1 or max(hist) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(s * n for s, n in hist.items())
    least = -(-total // capacity)
    best = best_fit(hist, capacity)
    bins = sum(n for _, n in best)
    free = dict(hist)
    path: list[tuple[Pattern, int]] = []
    stack: list[tuple[int, int, int, list[tuple[Pattern, int]]]] = []  # depth, waste, bins so far, branches left

    def branches(waste: int) -> list[tuple[Pattern, int]]:
        sizes = sorted(s for s, n in free.items() if n)
        top = sizes[-1]
        free[top] -= 1
        own = sizes if free[top] else sizes[:-1]
        options = fillings(capacity - top, own, free, width)
        free[top] += 1
        out = []
        for f in options:
            pattern = (top, *f)
            times = min(free[s] // pattern.count(s) for s in set(pattern))
            lost = capacity - sum(pattern)
            if lost:
                times = min(times, ((bins - 1) * capacity - total - waste) // lost)
            if times > 0:
                out.append((pattern, times))
        return out[::-1]

    if bins > least:
        stack.append((0, 0, 0, branches(0)))
    while stack and nodes > 0 and bins > least:
        depth, waste, made, left = stack[-1]
        while len(path) > depth:
            pattern, times = path.pop()
            for s in pattern:
                free[s] += times
        if not left:
            stack.pop()
            continue
        pattern, times = left.pop()
        waste += (capacity - sum(pattern)) * times
        if waste > (bins - 1) * capacity - total:
            continue
        nodes -= 1
        for s in pattern:
            free[s] -= times
        path.append((pattern, times))
        made += times
        if not any(free.values()):
            if made < bins:
                best, bins = list(path), made
            continue
        if (own := branches(waste)):
            stack.append((len(path), waste, made, own))
    return best


# --- placing ----------------------------------------------------------------------------------------


def places(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each length go: runs of ranks (key = length << 40 | first rank), each with its
    first sequence, uses in a sequence, and index of its offsets."""
    runs, offsets, seq, used = [], [], 0, {}
    for pattern, times in patterns:
        at, own = 0, {}
        for s in pattern:
            own.setdefault(s, []).append(at)
            at += s
        for s, where in own.items():
            first = used.get(s, 0)
            runs.append((s << 40 | first, seq, len(where), len(offsets)))
            offsets += where
            used[s] = first + times * len(where)
        seq += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4).T
    return (*[np.ascontiguousarray(c) for c in cols], np.array(offsets, np.int64))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of pieces() with sequence_id and offset. Reads its input twice, so give it stored rows.

    A piece's rank among all of its length is its rank in its task plus the pieces of that length in
    earlier tasks. Those sums run over one row per task and length, never over the pieces.
    """
    counts = store(rows.groupBy("length", "run").agg(F.count("*").alias("n")), "packing-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    if not hist:
        return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = rows.sparkSession.sparkContext.broadcast(places(solve(hist, capacity)))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, uses, index, offsets = table.value
        for b in batches:
            rank = b.column(5).to_numpy() + b.column(6).to_numpy()
            at = np.searchsorted(keys, b.column(3).to_numpy() << 40 | rank, "right") - 1
            k = rank - (keys[at] & ((1 << 40) - 1))
            sequence, offset = seqs[at] + k // uses[at], offsets[index[at] + k % uses[at]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return (
        rows.join(firsts, ["length", "run"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", "first", "place")
        .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece with its sequence and offset."""
    rows = pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity)
    return pack(store(rows, "packing-pieces"), capacity)
