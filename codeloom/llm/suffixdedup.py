"""Exact repeated passages by a distributed merge sort of sparse suffixes that never compares a known prefix twice.

Every byte covered by a LENGTH-byte string that also starts elsewhere is repeated. Anchors choose the suffixes
that need sorting: in each window of LENGTH bytes the GRAM-byte substrings of the least hash are anchors, which
depends on the window's bytes alone, so equal windows have equal anchors at equal places. Anchors whose hash
occurs once are done with. The suffixes of the others are sorted in each task together with what stands
before them (reversed), equal ones are merged, and the sorted runs travel front-coded: each string without the
prefix it shares with the one before. A loser tree that carries those prefix lengths merges the runs of a bin.
In the merged order, suffixes that share the gram stand together, and prefix lengths to both sides of
the anchor say which windows of a pair are equal: the match around it spans LENGTH bytes or more.

Texts are compared as UTF-8 bytes and each distinct text is handled once; a text that several rows hold is
repeated as a whole if it is long enough. Anchors of very many texts are split by the text around them, window
group by window group, so that no bin gathers a frequent passage with all its surroundings.

Null texts are empty. Repeated rows count as occurrences of their text each. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, passing, result, shared_dir, slices, steps, store, text_or_empty

LENGTH, GRAM = 200, 64
#: Grams in a window, and windows that hold an anchor in a given place.
WINDOW = LENGTH - GRAM + 1
#: Suffixes in a bin on average; suffixes a task sorts at a time; occurrences from which an anchor is split; windows of a split.
BIN, RUN, HOT, SPLIT = 20_000, 60_000, 2_000, 17
#: Ends a part of a sort key; no UTF-8 text holds it.
END = b"\xff"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """A 64-bit value for each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 7) | 1 for i in range(256)], np.uint64)


LETTERS = _letters()


def gram_hashes(raw: bytes, gram: int = GRAM) -> np.ndarray:
    """Hashes of all substrings of `gram` bytes (a power of two), by doubling."""
    h, power, size = LETTERS[np.frombuffer(raw, np.uint8)], MIX, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors. An anchor is least in some window: the largest window minimum around it is its own."""
    window = length - gram + 1
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = gram_hashes(raw, gram)
    h = (full >> np.uint64(32)).astype(np.uint32)
    least = _sliding(h, window, np.minimum)
    pad = np.zeros(window - 1, np.uint32)
    around = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    at = np.flatnonzero(around == h)
    return at, full[at].view(np.int64)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while True:
        mid = min(low + step, high)
        if a[low:mid] == b[low:mid]:
            low, step = mid, step * 2
        else:
            high = mid
            break
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def adjacent(keys: list[bytes]) -> list[int]:
    """Common prefix of each string with the one before; 0 for the first."""
    if len(keys) < 2:
        return [0] * len(keys)
    out = [0]
    for a, b in zip(keys, keys[1:], strict=False):
        out.append(common(a, b, 0))
    return out


def write_run(records: dict[bytes, list[tuple[int, int]]], texts: list[tuple[int, int]]) -> bytes:
    """A front-coded run: sorted keys without shared prefixes, then each key's occurrences (text, start)."""
    keys = sorted(records)
    shared = adjacent(keys)
    tails = [k[n:] for k, n in zip(keys, shared, strict=True)]
    refs = [r for k in keys for r in records[k]]
    used = sorted({t for t, _ in refs})
    short = {t: i for i, t in enumerate(used)}
    parts = (
        np.array(shared, "<u2"), np.array([len(t) for t in tails], "<u2"), np.array([len(records[k]) for k in keys], "<u4"),
        np.array([short[t] for t, _ in refs], "<u4"), np.array([p for _, p in refs], "<u8"), np.array([texts[t] for t in used], "<i8"),
    )
    return np.array([len(keys), len(refs), len(used)], "<u4").tobytes() + b"".join(p.tobytes() for p in parts) + b"".join(tails)


class Run:
    """A front-coded run, read one key at a time."""

    def __init__(self, raw: bytes) -> None:
        n, m, t = np.frombuffer(raw, "<u4", 3).tolist()
        at = 12

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.shared, lengths, counts = take("<u2", n).tolist(), take("<u2", n), take("<u4", n)
        text, start = take("<u4", m), take("<u8", m)
        table = take("<i8", 2 * t).reshape(-1, 2)
        self.refs = np.column_stack([table[text], start.astype(np.int64)]) if m else np.empty((0, 3), np.int64)
        self.ends = (at + np.cumsum(lengths, dtype=np.int64)).tolist()
        self.starts = [at, *self.ends[:-1]]
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist()
        self.raw, self.i, self.key = raw, -1, b""

    def next(self) -> bool:
        self.i += 1
        if self.i == len(self.starts):
            return False
        self.key = self.key[: self.shared[self.i]] + self.raw[self.starts[self.i] : self.ends[self.i]]
        return True

    def occurrences(self) -> np.ndarray:
        return self.refs[self.first[self.i] : self.first[self.i + 1]]


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(key, prefix shared with the key before, occurrences) of all runs in order, by a loser tree.

    ``known[r]`` is the prefix that run r's key shares with the last key put out. Of two keys the one that
    shares more is the smaller and the other's length stays right; only at a draw are bytes compared, from there on.
    """
    live = [r for r in runs if r.next()]
    n = len(live)
    if not n:
        return
    known: list[int] = [0] * n
    done = [False] * n
    losers = [-1] * n  # node 1.. are matches; a leaf r hangs below node (n + r) // 2

    def play(a: int, b: int) -> tuple[int, int]:
        if done[b]:
            return a, b
        if done[a]:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = live[a].key, live[b].key
        m = common(x, y, ka)
        first = m == len(x) or (m < len(y) and x[m] < y[m])
        winner, loser = (a, b) if first else (b, a)
        known[loser] = m
        return winner, loser

    # build from the leaves up
    winners = [-1] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if n > 1 else 0
    while not done[top]:
        run = live[top]
        yield run.key, known[top], run.occurrences()
        if run.next():
            known[top] = run.shared[run.i]
        else:
            done[top] = True
        node = (n + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def block_extents(lefts: list[bytes], rights: list[bytes], shared: list[int], counts: list[int], span: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """For each record of a block (sorted by right side; ``shared[i]`` is the common prefix of right sides i - 1 and i),
    how far the repeated windows around its start reach to the left and to the right; (0, 0) if none repeats."""
    n = len(lefts)
    out = [(len(a), len(b)) if c > 1 and len(a) + len(b) >= length else (0, 0) for a, b, c in zip(lefts, rights, counts, strict=True)]
    single = [i for i in range(n) if counts[i] == 1]
    if n == 1 or not single:
        return out
    if len(single) * n <= 2500:
        for i in single:
            best_l, best_r = 0, 0
            for step in (-1, 1):
                mr, j = len(rights[i]), i + step
                while 0 <= j < n:
                    mr = min(mr, shared[max(j, j - step)])
                    if mr + span < length:
                        break
                    ml = common(lefts[i], lefts[j], 0)
                    if ml + mr >= length:
                        best_l, best_r = max(best_l, ml), max(best_r, mr)
                    j += step
            out[i] = (best_l, best_r)
        return out
    # many records: window group by window group, records of equal right and left group have equal windows
    right = np.array(shared)
    right[0] = 0
    order = sorted(range(n), key=lefts.__getitem__)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    left = np.array(adjacent([lefts[i] for i in order]))
    len_l, len_r, count = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights]), np.array(counts)
    low, high = np.full(n, span + 1), np.full(n, -1)
    for j in range(span + 1):
        fits = (len_l >= j) & (len_r >= length - j)
        rg = np.cumsum(right < length - j)
        lg = np.cumsum(left < j)[place]
        _, inverse = np.unique(rg * np.int64(n + 1) + lg, return_inverse=True)
        many = np.bincount(inverse, np.where(fits, count, 0))[inverse] > 1
        hit = fits & many
        high[hit] = j
        low[hit] = np.minimum(low[hit], j)
    return [(int(h), length - int(lo)) if h >= 0 else o for o, lo, h in zip(out, low, high, strict=True)]


def resolve(runs: list[Run], span: int, length: int = LENGTH, lead: int = 0) -> Iterator[tuple[np.ndarray, int, int]]:
    """(occurrences, reach to the left, reach to the right) of the records of a bin that are repeated. ``lead``
    bytes before the right side must agree as well."""
    block: list[tuple[bytes, bytes, int, list[np.ndarray]]] = []

    def close() -> Iterator[tuple[np.ndarray, int, int]]:
        counts = [sum(map(len, b[3])) for b in block]
        if len(block) > 1 or counts[0] > 1:
            reach = block_extents([b[1] for b in block], [b[0] for b in block], [b[2] for b in block], counts, span, length)
            for b, (ml, mr) in zip(block, reach, strict=True):
                if mr:
                    for refs in b[3]:
                        yield refs, ml, mr

    last = b""
    for key, shared, refs in merge(runs):
        if block and shared == len(key) == len(last):
            block[-1][3].append(refs)
            continue
        right, left, _ = key[lead:].split(END)
        m = min(shared - lead, len(right), len(block[-1][0]) if block else 0)
        if block and m < length - span:
            yield from close()
            block = []
        block.append((right, left, m, [refs]))
        last = key
    if block:
        yield from close()


def _runs(bins: int, length: int, gram: int, span: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int, int]] = []
        own: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            numbers = list(own)
            coded = [write_run(own[b], texts) for b in numbers]
            own.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(coded, pa.binary())], names=["bin", "run"])

        for b in slices(batches, 64):
            for d1, d2, text, at, hashes, hot in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw, t = text.encode("utf-8", "surrogatepass"), len(texts)
                texts.append((d1, d2))
                for a, h, many in zip(at, hashes, hot, strict=True):
                    if not many:
                        key = raw[a : a + length] + END + raw[max(0, a - span) : a][::-1] + END
                        own.setdefault(h % bins, {}).setdefault(key, []).append((t, a))
                        size += 1
                        continue
                    for k in range(0, span + 1, SPLIT):  # windows that start k .. k + SPLIT - 1 bytes before the anchor
                        start, room = a - k, min(SPLIT - 1, span - k)
                        core = raw[max(0, start) : max(0, start + length - room)]
                        if start < 0 or len(core) < length - room:
                            continue
                        # k leads the key: one place reached from two anchors must not look like two places
                        key = bytes([k]) + raw[start : start + length] + END + raw[max(0, start - room) : start][::-1] + END
                        own.setdefault(bins + xxhash.xxh64_intdigest(core, k) % bins, {}).setdefault(key, []).append((t, start))
                        size += 1
                if size >= RUN:
                    yield out()
                    size = 0
        if own:
            yield out()

    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """d1, d2 (hashes of the text), text, copies: one row per distinct text, bucketed by d1 so that later joins leave the texts in place."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), text.alias("text"))
    once = rows.groupBy("d1", "d2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    n = partitions(spark)
    once.repartition(n, "d1").write.bucketBy(n, "d1").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    passing(f"{shared_dir(spark)}/{name}", name)
    return spark.table(name)


def _by_text(texts: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the text's hashes; d2 is compared as a residue, so that the bucketing by d1 serves the join."""
    own = rows.withColumnsRenamed({"d1": "r1", "d2": "r2"})
    return texts.join(own, (F.col("d1") == F.col("r1")) & (F.col("d2").bitwiseXOR(F.col("r2")) == 0), how).drop("r1", "r2")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """d1, d2, spans: array of (lo, hi) byte ranges, overlapping ones included, that repeat across or within distinct texts."""
    span = length - gram
    spark = texts.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d1, d2, at, hashes = [], [], [], []
            for x, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                p, h = anchors(text.encode("utf-8", "surrogatepass"), length, gram)
                d1.append(np.full(len(p), x, np.int64)), d2.append(np.full(len(p), y, np.int64)), at.append(p), hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (d1, d2, at, hashes)], names=["d1", "d2", "at", "hash"])

    found = store(texts.select("d1", "d2", "text").mapInArrow(find, "d1 long, d2 long, at long, hash long"), "anchors")
    many = store(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > hot).alias("hot")), "anchor-counts")
    again = store(found.join(many.hint("shuffle_hash"), "hash").groupBy("d1", "d2").agg(F.collect_list(F.struct("at", "hash", "hot")).alias("own")), "anchors-again")
    total = again.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    bins = max(partitions(spark), -(-total // BIN))
    met = _by_text(texts.select("d1", "d2", "text"), again).select("d1", "d2", "text", "own.at", "own.hash", "own.hot")
    runs = met.mapInArrow(_runs(bins, length, gram, span), "bin int, run binary")

    def sort(table: pa.Table) -> pa.Table:
        own = table.column("bin")[0].as_py()
        rows = [np.empty((0, 4), np.int64)]
        split = own >= bins
        for refs, ml, mr in resolve([Run(r) for r in table.column("run").to_pylist()], SPLIT - 1 if split else span, length, int(split)):
            rows.append(np.column_stack([refs[:, :2], refs[:, 2] - ml, refs[:, 2] + mr]))
        got = np.concatenate(rows)
        return pa.table({n: pa.array(np.ascontiguousarray(got[:, i])) for i, n in enumerate(("d1", "d2", "lo", "hi"))})

    spans = runs.groupBy("bin").applyInArrow(sort, "d1 long, d2 long, lo long, hi long")
    return store(spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def merged(spans: list[tuple[int, int]] | None, size: int, copies: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs of a text."""
    if copies > 1 and size >= length:
        return [(0, size)]
    out: list[list[int]] = []
    for lo, hi in sorted(spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _finish(texts: DataFrame, spans: DataFrame, schema: str, make, length: int) -> DataFrame:  # noqa: ANN001
    """make(raw, runs) of every distinct text, keyed by d1, d2."""
    joined = _by_text(texts, spans, "left").select("d1", "d2", "text", "copies", "spans.lo", "spans.hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = []
            for text, copies, lo, hi in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows.append(make(raw, merged(list(zip(lo or (), hi or (), strict=True)), len(raw), copies, length)))
            names = [c.split()[0] for c in schema.split(", ")]
            cols = [pa.array([r[i] for r in rows], pa.string() if " string" in c else pa.int64()) for i, c in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["d1", "d2", *names])

    return joined.mapInArrow(run, f"d1 long, d2 long, {schema}")


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that remain."""

    def make(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(raw, runs)).hexdigest()

    with steps(docs.sparkSession):
        texts = distinct_texts(docs)
        done = result(_finish(texts, repeated_spans(texts, length, gram), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, length), "texts-done")
    text = text_or_empty()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    return own.join(done, ["d1", "d2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``, its columns unchanged, with the repeated bytes taken out of ``text``; a character cut in two goes whole."""

    def make(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return (kept(raw, runs).decode("utf-8", "ignore"),) if runs else (None,)  # None: unchanged

    d1, d2, new = fresh(docs, "suffix_d1", "suffix_d2", "suffix_text")
    with steps(docs.sparkSession):
        texts = distinct_texts(docs)
        changed = _finish(texts, repeated_spans(texts, length, gram), "new string", make, length)
        changed = result(changed.where("new is not null").toDF(d1, d2, new), "texts-changed")
    own = docs.withColumn(d1, F.xxhash64(text_or_empty())).withColumn(d2, F.xxhash64(F.lit(1), text_or_empty()))
    met = own.join(changed.hint("merge"), [d1, d2], "left").withColumn("text", F.coalesce(F.col(new), F.col("text")))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return met.select(*docs.columns)
