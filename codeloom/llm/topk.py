"""Exact top-k inner products by descending length.

Candidates are taken in blocks of descending norm. All vectors are rotated onto the singular directions of the
table, so that the leading coordinates carry most of an inner product; the rest of it is at most the product of
the residual norms (Cauchy-Schwarz). The block of the longest vectors gives each query a first k-th score;
a later block is visited only if the product of norms can reach it, and within a block only candidates whose
partial sum plus residual bound can reach it are scored. Scores are exact integers; the rotation decides
only what is skipped, with a margin far above its rounding error. Blocks are at most BLOCKS; beyond that each
is dealt in salted shares, so the tasks that meet candidates grow with the table.

Vectors that are null, empty or hold null or non-finite components take no part. Shorter vectors count as
padded with zeros. Ties go to the smaller vec_id; rows that share a vec_id are all candidates of other ids, and
a row is excluded from its own query by its id. Query rows that share an id have one ranking, of the pairs of
any of them with any candidate. Rows without an id take no part. Coordinates beyond the first ROTATED are not
rotated and count in the residual; pieces of very long vectors hold fewer rows. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, slices, store

K, EVERY, SCALE = 20, 20, 64
#: Leading rotated coordinates of the partial sums, rows of a block's piece, queries of a batch, and blocks at most.
LEAD, PIECE, BATCH, BLOCKS = 16, 4096, 512, 1024
#: Coordinates that are rotated at most, numbers of a piece at most, query batches whose best a task keeps at a time.
ROTATED, CELLS, OPEN = 1024, 1 << 22, 64
MARGIN = 1e-6


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components ``v`` of the vectors that take part, with their length ``norm``."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    out = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix padded with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False)):
        out[i, : b - a] = flat[a:b]
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Singular directions of the table's first ``width`` coordinates as columns, largest first, from sums of products made in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    sums = rows.select(F.slice("v", 1, width)).mapInArrow(run, "row int, sums array<double>").select("row", F.posexplode("sums").alias("at", "x"))
    got = sums.groupBy("row", "at").agg(F.sum("x").alias("x")).collect()  # width x width numbers
    gram = np.zeros((width, width))
    for r in got:
        gram[r["row"], r["at"]] = r["x"]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def narrow(longest: float) -> np.dtype:
    """The smallest type of whole numbers for the components of vectors of at most that norm: blobs are exchanged for many pairs of them."""
    return np.dtype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if longest < np.iinfo(t).max))


def _wide(m: bytes, width: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(m, kind).reshape(-1, width).astype(np.int64)


def _blobs(rows: DataFrame, width: int, size: int, kind: np.dtype) -> DataFrame:
    """Rows of a partition packed into blobs of at most ``size`` vectors of one share (salt) of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: int, salt: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            norm = float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([norm]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary())],
                names=["block", "salt", "top", "ids", "m"],
            )

        for b in slices(batches, size):
            blocks, salts, ids, m = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), width)
            for own, salt in sorted(set(zip(blocks.tolist(), salts.tolist(), strict=True))):
                at = np.flatnonzero((blocks == own) & (salts == salt))
                yield out(own, salt, ids[at], m[at])

    return rows.select("block", "salt", "vec_id", "v").mapInArrow(run, "block int, salt int, top double, ids binary, m binary")


def longest_blob(candidates: DataFrame) -> Row:
    """The blob of the longest vectors, at most PIECE of them. Blobs aren't ordered, as each task would send the driver one of its own."""
    names = ["top", "block", "salt", "own"]
    named = candidates.withColumn("own", F.xxhash64("ids"))
    at = named.agg(F.max(F.struct(*names)).alias("at")).first()["at"]
    return named.where(F.struct(*names) == F.struct(*[F.lit(at[c]) for c in names])).select("ids", "m").limit(1).collect()[0]


def best(ids: np.ndarray, q: np.ndarray, cand_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best among these candidates that reach ``least``."""
    lead = min(LEAD, len(turn))
    rq, rc = q[:, : len(turn)] @ turn[:, :lead], c[:, : len(turn)] @ turn[:, :lead]
    all_q, all_c = np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(c.astype(float), axis=1)
    # a rotation keeps lengths, so what the leading coordinates leave is the rest; its rounding is covered by the margin of the full lengths
    rest_q, rest_c = (np.sqrt(np.maximum(0, n**2 - (r**2).sum(1))) for n, r in ((all_q, rq), (all_c, rc)))
    bound = rq @ rc.T + np.outer(rest_q, rest_c)
    bound += MARGIN * (1 + np.abs(bound)) + MARGIN * np.outer(all_q, all_c)
    # where many pass, one product of the matrices scores them; floats are exact, as no sum exceeds the norms' product
    full = None
    if least is not None and len(c) and len(q) and float(all_q.max()) * float(all_c.max()) < 2.0**52 and 32 * np.count_nonzero(bound >= least[:, None]) > bound.size:
        full = q.astype(float) @ c.astype(float).T
    scores = lambda i, at: c[at] @ q[i] if full is None else full[i][at].astype(np.int64)
    for i in range(len(ids)):
        floor = -np.inf if least is None else least[i]
        at = np.flatnonzero(bound[i] >= floor)
        at = at[cand_ids[at] != ids[i]]
        if len(at) > 4 * k and floor == -np.inf:  # the k best bounds give a score to prune by
            first = at[np.argpartition(-bound[i][at], k - 1)[:k]]
            floor = np.sort(c[first] @ q[i])[0]
            at = at[bound[i][at] >= floor]
        score = scores(i, at)
        keep = score >= floor
        at, score = at[keep], score[keep]
        order = np.lexsort((cand_ids[at], -score))[:k]
        yield i, cand_ids[at][order], score[order]


PAIRS = "query_id long, vec_id long, score long"


def _pairs(q: list[np.ndarray], v: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(x).astype(np.int64)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, is_query: Column | None = None, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query (default: vec_id divisible by EVERY)."""
    spark = vectors.sparkSession
    is_query = F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0 if is_query is None else is_query
    rows = store(quantised(vectors, scale), "vectors")
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if (longest or 0) >= 2.0**31:
        raise ValueError("components too large for exact 64-bit scores")
    turn = rotation(rows, min(width, ROTATED))
    kind = narrow(longest or 0)
    piece, batch = (max(1, min(most, CELLS // width)) for most in (PIECE, BATCH))
    # Blocks by descending norm: quantiles cut the range, so that a block holds about n / blocks rows.
    blocks = int(min(BLOCKS, max(1, n // piece)))
    salts = int(max(1, n // (blocks * piece)))
    cuts = sorted(set(rows.approxQuantile("norm", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else None
    block = F.size(F.filter(edges, lambda e: e > F.col("norm"))) if cuts else F.lit(0)
    # the salt is a hash of the row, so that a task made again after a loss deals the same rows
    own = F.xxhash64("vec_id", "v")
    dealt = rows.withColumns({"block": block.cast("int"), "salt": F.pmod(own, F.lit(salts)).cast("int")})
    shares = dealt.repartition(max(partitions(spark), blocks), "block", "salt", F.pmod(F.shiftright(own, 32), F.lit(8)))
    candidates = store(_blobs(shares.sortWithinPartitions("block", "salt"), width, piece, kind), "candidates")
    queries = store(_blobs(dealt.where(is_query).withColumns({"block": F.lit(0), "salt": F.lit(0)}), width, batch, kind), "queries")  # full batches, of any length
    tops = {r["block"]: r["top"] for r in candidates.groupBy("block").agg(F.max("top").alias("top")).collect()}  # at most BLOCKS rows
    head = longest_blob(candidates)
    shared = spark.sparkContext.broadcast((turn, tops, np.frombuffer(head["ids"], np.int64), _wide(head["m"], width, kind)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch of queries with the k-th scores from the longest candidates, once for each block that can reach one of them."""
        turn, tops, head_ids, head_m = shared.value
        for b in batches:
            for ids, m, batch in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                own, q = np.frombuffer(ids, np.int64), _wide(m, width, kind)
                least = np.full(len(own), np.iinfo(np.int64).min // 2)
                for i, _, score in best(own, q, head_ids, head_m, turn, k):
                    if len(score) == k:
                        least[i] = score[-1]
                norms = np.linalg.norm(q.astype(float), axis=1)
                for to, top in sorted(tops.items(), key=lambda x: -x[1]):
                    some = np.flatnonzero(norms * top * (1 + MARGIN) + MARGIN >= least)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([to], pa.int32()), pa.array([batch], pa.int64()), pa.array([own[some].tobytes()], pa.binary()), pa.array([q[some].astype(kind).tobytes()], pa.binary()), pa.array([least[some].tobytes()], pa.binary())],
                            names=["block", "batch", "q_ids", "q_m", "least"],
                        )

    visits = queries.select("ids", "m", F.xxhash64("ids").alias("batch")).mapInArrow(first, "block int, batch long, q_ids binary, q_m binary, least binary")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        opened: OrderedDict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = OrderedDict()  # by batch and query: the k best so far

        def out(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return _pairs([np.full(len(v), i) for i, (v, _) in held.items()], [v for v, _ in held.values()], [s for _, s in held.values()])

        for b in batches:
            for batch, q_ids, q_m, least, ids, m in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                held = opened.setdefault(batch, {})
                opened.move_to_end(batch)
                if len(opened) > OPEN:  # the batch that was not visited for longest gives what it has; the rest of its visits add to that
                    yield out(opened.popitem(last=False)[1])
                own, q = np.frombuffer(q_ids, np.int64), _wide(q_m, width, kind)
                floor = np.frombuffer(least, np.int64).copy()
                for i, x in enumerate(own.tolist()):
                    if x in held and len(held[x][1]) == k:
                        floor[i] = max(floor[i], held[x][1][-1])
                for i, v, score in best(own, q, np.frombuffer(ids, np.int64), _wide(m, width, kind), turn, k, floor):
                    if len(v):
                        x = int(own[i])
                        if x in held:
                            v, score = np.concatenate([held[x][0], v]), np.concatenate([held[x][1], score])
                            order = np.lexsort((v, -score))[:k]
                            v, score = v[order], score[order]
                        held[x] = v, score
        for held in opened.values():
            yield out(held)

    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # never a broadcast: each block's visits hold the queries anew, so they are many times the stored queries by which Spark judges their size
    # and as many parts as blocks, whatever their bytes: small blobs are much work
    visits, met = (x.repartition(max(partitions(spark), blocks), "block", "salt") for x in (visits, candidates.select("block", "salt", "ids", "m")))
    met = visits.join(met.hint("merge"), ["block", "salt"]).select("batch", "q_ids", "q_m", "least", "ids", "m").mapInArrow(visit, PAIRS)
    # of each task's rows the k best are kept before the exchange (a limit on row_number, as Spark plans it)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
