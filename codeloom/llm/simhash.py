"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a nonzero vector over GF(2) of radius + 1 dimensions. Each nonzero vector v
of that space makes a table whose mask holds the bits that aren't orthogonal to v. The bits in which two
fingerprints within the radius differ span at most `radius` dimensions, so some v is orthogonal to them all:
the pair agrees under that mask and collides in that table. No pair within the radius is lost.

Links join distinct fingerprints, so copies cost nothing. A table's bucket is compared in blocks of bounded
size, and of the links found in one comparison only a spanning forest goes on.

Null texts are empty; texts without words have fingerprint 0 and are linked as any other. Ties, repeated rows
and repeated doc_ids give one result row per input row; a component's id is its least doc_id (nulls aside).
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, result, slices, steps, store, text_or_empty
from .components import components

BITS = 64
SEED = 42
WORDS = 4
RADIUS = 4
#: The pipeline's stage: words of a shingle, similarity of a link, and bits in which the fingerprints of its candidates' words may differ.
STAGE_WORDS, SIMILARITY, STAGE_RADIUS = 5, 0.8, 6
#: Comparisons for each row of its open buckets that the stage makes at once; with more to make it first joins components by one row of each bucket.
PAIRS = 64
#: A round of joining components by one row of each bucket is the last one if it finds less than a link for so many of these rows.
PAYS = 100
#: Parts that the rows of a bucket are dealt to when they are compared with one another.
SALTS = 16
#: Texts that show which shingles are frequent, how many of these must hold one, and how many such shingles are told to the tasks at most.
SHOWN, FREQUENT, TOLD = 1 << 14, 8, 1 << 16
#: Fingerprints of a bucket that one comparison takes on each side.
BLOCK = 1500


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text."""
    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(own) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    ends = ends[words - 1 :].tolist()
    for at in range(0, len(starts), 65_536):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed long, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each nonzero v in GF(2)^(radius + 1), as unsigned ints; the vectors of the bits go round all nonzero ones."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the buckets of sorted `keys`: each row is compared with the next ones of its bucket."""
    n = len(keys)
    label = np.arange(n)
    found_a, found_b = [], []
    step = 1
    alive = np.arange(n - 1) if n > 1 else np.empty(0, np.int64)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    while True:
        alive = alive[alive + step < n]
        alive = alive[keys[alive] == keys[alive + step]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + step]) <= radius]
        near = near[label[near] != label[near + step]]
        for i in near.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                label[max(a, b)] = min(a, b)
                found_a.append(i)
                found_b.append(i + step)
        if len(near):
            while True:  # flatten, so that the filter above sees roots
                flat = label[label]
                if np.array_equal(flat, label):
                    break
                label = flat
        step += 1
    return fps[np.array(found_a, np.int64)], fps[np.array(found_b, np.int64)]


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (column fp) that keep every component of the radius graph."""
    spark = prints.sparkSession
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(radius))])
    rows = prints.select("fp", F.explode(tables).alias("bucket"))
    counts = store(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    # A bucket of over `block` rows is cut into parts; each pair of parts is a comparison of its own.
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(-1), "fp"), parts).cast("int")
    met = rows.join(counts, "bucket").select(
        "fp", "bucket", own.alias("own"),
        F.explode(F.when(parts == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))).alias("other"),
    )
    cells = met.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = forest(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(1).to_numpy()])
            f = np.concatenate([rest_f, batch.column(0).to_numpy().view(np.uint64)])
            cut = np.searchsorted(k, k[-1]) if len(k) else 0  # the last cell may go on in the next batch
            yield out(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield out(rest_k, rest_f)

    return cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = store(fingerprints(docs, words), "fingerprints")
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    roots = store(components(store(links(distinct, radius), "links")), "fp-roots").withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = store(
        distinct.join(roots.join(ids, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")),
        "fp-components",
    )
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_hashes(text: str) -> np.ndarray:
    own = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), np.uint64, len(own))


def word_fingerprint(text: str | np.ndarray) -> int:
    """The 64-bit fingerprint of the distinct words of a text (or of their hashes): a few changed words turn few of its bits, where shingles would turn many."""
    own = np.unique(_word_hashes(text) if isinstance(text, str) else text)
    if not len(own):
        return 0
    ones = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0])


def shingles(text: str, words: int) -> set[bytes]:
    own = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def shingle_hashes(text: str | np.ndarray, words: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text (or of the hashes of its words), ascending."""
    h = _word_hashes(text) if isinstance(text, str) else text
    n = max(1, len(h) - words + 1)
    mixed = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many of some SHOWN texts (node, text) hold, ascending, TOLD at most. They only come last in an order, so any choice is right."""
    turn = max(1, texts.count() // SHOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            found = [shingle_hashes(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(turn)) == 0).select("text")
    counts = store(some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT), "near-frequent")
    least, told = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("hashes")).orderBy(F.desc("n")).collect():  # a row for each count
        told += r["hashes"]
        if told > TOLD:
            break
        least = r["n"]
    found = [] if least is None else [r["h"] for r in counts.where(F.col("n") >= least).select("h").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes, those in ``last`` behind all others, of which two texts of that similarity have one in common: a text shares all but so many less one."""
    if len(last):
        late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts share enough of their shingles, by exact count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], 64):
                keep, last, own = [], None, set()
                for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if ta != last:
                        last, own = ta, shingles(ta, words)
                    other = shingles(tb, words)
                    both = len(own & other)
                    keep.append(both >= similarity * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays(list(b.select([0, 1]).filter(pa.array(keep, pa.bool_())).columns), names=["a", "b"])

    met = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS) -> tuple[DataFrame, DataFrame]:
    """(texts, roots): node (of the text), nid and first (least doc_id) of each distinct text, and (node, root) of the nids that have a similar text.

    A link is a pair whose word fingerprints differ in at most ``radius`` bits and whose ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Such a pair has a shingle in common among the first of each in any order of all shingles, so these are the buckets and
    none is lost; covering masks of the fingerprints put texts together that have the same common words, more pairs by far. Frequent shingles come
    last in the order. A bucket's texts are held against its least one; only those that this leaves outside that one's component are held against
    texts of other components.
    """
    spread = partitions(docs.sparkSession)  # small tables that much is made of are dealt to all tasks
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty())).alias("node"), text_or_empty().alias("text")).where("doc_id is not null")
    last = docs.sparkSession.sparkContext.broadcast(frequent(named.select("node", "text"), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [_word_hashes(t) for t in b.column(2).to_pylist()]
            own = np.array([word_fingerprint(t) for t in texts], np.uint64).view(np.int64)
            hashes = [shingle_hashes(t, words) for t in texts]
            first = [prefix(h, last.value, similarity).view(np.int64) for h in hashes]
            columns = [b.column(0), b.column(1), pa.array(own), pa.array(list(map(len, hashes)), pa.int32()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "size", "first_hashes"])

    rows = store(named.mapInArrow(run, "doc_id long, node binary, fp long, size int, first_hashes array<long>"), "near-rows")
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "first_hashes")])
    distinct = store(distinct.repartition(spread, "node").withColumn("nid", F.monotonically_increasing_id()), "near-texts")
    placed = distinct.select("nid", "fp", "size", F.posexplode("first_hashes").alias("at", "bucket"))
    shared = store(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    met = store(placed.join(shared, "bucket"), "near-met")
    low = met.groupBy("bucket").agg(F.min(F.struct("nid", "fp", "size", "at")).alias("low")).select("bucket", F.col("low.nid").alias("other"), *[F.col(f"low.{c}").alias(f"{c}_a") for c in JUDGED])
    close = _near(radius, similarity)
    star = store(met.join(low, "bucket").where((F.col("nid") != F.col("other")) & close).select(F.col("other").alias("a"), F.col("nid").alias("b")).distinct(), "near-star")
    # texts of all that is still to be compared: the star's pairs, and buckets of three or more
    wanted = star.select(F.explode(F.array("a", "b")).alias("nid")).union(met.where("n > 2").select("nid")).distinct()
    wanted = store(distinct.join(wanted, "nid").select("nid", "node"), "near-wanted")
    texts = store(named.join(wanted, "node").select("nid", "text").dropDuplicates(["nid"]), "near-read")
    linked = store(_alike(star, texts, words, similarity), "near-links")
    met, turn = store(met.where("n > 2"), "near-met"), 0
    names = [("nid", "other"), ("root", "other_root"), *[(c, f"{c}_a") for c in JUDGED]]
    while True:
        roots = store(components(linked), "near-roots")
        rooted = store(met.join(roots.select(F.col("node").alias("nid"), "root"), "nid", "left").select("bucket", "nid", *JUDGED, F.coalesce("root", "nid").alias("root")), "near-rooted")
        low = rooted.groupBy("bucket").agg(F.min("nid").alias("least"), F.min_by("root", "nid").alias("least_root"), F.countDistinct("root").alias("roots"), F.count("*").alias("n"))
        mixed = store(rooted.join(low.where("roots > 1"), "bucket").repartition(spread, "nid", "bucket"), "near-mixed")
        pairs, rows = mixed.agg(F.coalesce(F.sum(F.when(F.col("root") != F.col("least_root"), F.col("n"))), F.lit(0)), F.count("*")).first()
        outside = mixed.where("root <> least_root")
        if pairs <= PAIRS * rows:
            break
        # many pairs are left: another member of each bucket is held against all that is in other components, which joins most of them
        other = outside.groupBy("bucket").agg(*[F.min_by(c, F.xxhash64("nid", F.lit(turn))).alias(n) for c, n in names])
        found = store(_alike(_across(mixed, other, close), texts, words, similarity), "near-links")
        turn += 1
        if found.count() * PAYS < rows:
            break
        linked = store(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "near-links")
    rest = _across(mixed.where(F.col("nid") != F.col("least")), outside.select("bucket", *[F.col(c).alias(n) for c, n in names]), close)
    more = store(_alike(store(rest, "near-rest"), texts, words, similarity), "near-links")
    return distinct, roots if more.isEmpty() else store(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "near-roots")


#: What two texts of a bucket are judged by before they are read: fingerprint, number of shingles, and the place there of the bucket's shingle.
JUDGED = ("fp", "size", "at")


def _near(radius: int, similarity: float) -> Column:
    """Whether a pair may be a link: within the radius, and with enough shingles in common if the bucket's is the first one that is."""
    common = F.least(F.col("size") - F.col("at"), F.col("size_a") - F.col("at_a"))
    return (common >= similarity / (1 + similarity) * (F.col("size") + F.col("size_a")) - 1e-6) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_a"))) <= radius)


def _across(mixed: DataFrame, others: DataFrame, close: Column) -> DataFrame:
    """Close pairs (a, b) of a bucket's rows and its ``others`` (bucket, other, other_root and what they are judged by), of different components."""
    # rows are few and pairs many: dealt by bucket and salt, so that a hot bucket is not the work of one task
    spread, salts = partitions(mixed.sparkSession), F.sequence(F.lit(0), F.lit(SALTS - 1))
    own = mixed.withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(SALTS)).cast("int")).repartition(spread, "bucket", "salt")
    others = others.withColumn("salt", F.explode(salts)).repartition(spread, "bucket", "salt")
    pairs = own.join(others.hint("merge"), ["bucket", "salt"]).where((F.col("root") != F.col("other_root")) & close)
    return pairs.select(F.least("nid", "other").alias("a"), F.greatest("nid", "other").alias("b")).distinct()


def keep_one(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS) -> DataFrame:
    """``docs`` with one document of each group of similar texts: that of the least doc_id, of equal ids that of the least text hash. Equal rows
    count as one document; rows without an id stay. Texts without words are alike."""
    with steps(docs.sparkSession):
        kept = result(_firsts(docs, words, similarity, radius), "kept")
    node, first = fresh(docs, "near_node", "near_first")
    kept = kept.select(F.col("node").alias(node), F.col("first").alias(first)).hint("merge")
    # the join is dealt by the text, which serves the removal of equal rows as well
    own = docs.where(F.col("doc_id").isNotNull()).withColumn(node, F.unhex(F.md5(text_or_empty())))
    chosen = own.join(kept, node).where(F.col("doc_id").cast("long") == F.col(first)).dropDuplicates([node])
    return chosen.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def _firsts(docs: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """node and first of the text that stays, by group."""
    texts, roots = similar(docs, words, similarity, radius)
    named = texts.join(roots.select(F.col("node").alias("nid"), "root"), "nid", "left").select("node", "first", F.coalesce("root", "nid").alias("root"))
    return named.groupBy("root").agg(F.min(F.struct("first", "node")).alias("keep")).select("keep.node", "keep.first")
