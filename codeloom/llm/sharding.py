"""Sharding by jump consistent hashing, native DataFrame expressions only.

The shard follows from the key and the number of shards alone; with one more shard, rows move only into it.
A null key counts as the hash of null, a null text as no bytes. Repeated rows share a shard and get slots of
their own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, store

SHARDS = 24
#: Fixed values of the published generator: the multiplier of its 64-bit linear congruence.
MULTIPLIER = 2862933555777941757
LOW = (1 << 32) - 1
#: Jumps made without a look at the shard count; a key needs ln(shards) of them on average.
JUMPS = 24


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on unsigned 32-bit halves; no product or sum exceeds a long."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW
    low16 = lambda c: c.bitwiseAND(0xFFFF)
    a, b = low16(lo) * m_lo + 1, F.shiftright(lo, 16) * m_lo
    t = a + F.shiftleft(low16(b), 16)
    carry = F.shiftright(t, 32) + F.shiftright(b, 16)
    cross = (lo * m_hi).bitwiseAND(LOW) + (low16(hi) * m_lo).bitwiseAND(LOW) + F.shiftleft(low16(F.shiftright(hi, 16) * m_lo), 16)
    return (carry + cross).bitwiseAND(LOW), t.bitwiseAND(LOW)


def jump(key: Column, shards: int) -> Column:
    """struct<hi, lo, b, j> after the last jump: ``b`` is the shard, ``j`` the bucket count at which the key moves next."""

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        # (key >>> 33) + 1 of the new key; its top 31 bits are the high half without its lowest bit
        far = ((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), far.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    zero = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )
    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(JUMPS, shards))), zero, step)
    if shards <= JUMPS:
        return few
    return F.when(few["j"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(shards)), few, step)).otherwise(few)


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots are gapless from 0 in each shard without a sort of the shard: rows rank within buckets of a shard,
    and a bucket starts where the earlier buckets of the shard end.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(content).cast("long") + 8).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        jump(F.xxhash64(F.col(key).cast("long")), shards).alias("to"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.col("to.b").cast("int").alias("shard"),
        F.when(F.col("to.j") == shards, shards).otherwise(F.col("to.b")).cast("int").alias("grown_shard"),
    )
    buckets = max(16, partitions(docs.sparkSession))
    rows = store(rows.withColumn("bucket", F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(buckets)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank - 1).join(firsts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"), "grown_shard"
    )
