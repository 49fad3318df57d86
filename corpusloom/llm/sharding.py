"""Rendezvous hashing of stable record keys over weighted shards, by DataFrame functions only.

Each shard j draws a number from the hash of (key, j); the shard with the best draw, scaled by its
weight, takes the record. A further shard only takes records to itself, as other draws stay. The key
alone decides: repeated keys share a shard, and a null key is a key of its own. Slots number a shard's
records without gaps, by buckets of equal hashes of the record, so no task ever holds a whole shard.
Slots of records that are equal in key, size and checksum are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each shard; a task numbers the records of some buckets.
BUCKETS = 4096


def _draw(key: Column, shard: int, weight: float) -> Column:
    # 53 bits of the hash as a number between 0 and 1, never 0; -ln(u) / weight is least for the winner
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of each key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    # a null adds nothing to the hash, so it is marked
    given = F.concat(F.when(key.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(key.cast("string"), F.lit("")))
    return F.array_min(F.array(*[_draw(given, j, w) for j, w in enumerate(weights)]))["shard"]


def assign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, next_weight: float = 1.0, keep: Sequence[str] | None = None) -> DataFrame:
    """`row` with size, text_crc32, shard, slot and grown_shard (with one more shard)."""
    names = docs.columns if keep is None else list(keep)
    body, own = F.col(f"`{text}`").cast("string"), F.col(f"`{key}`")
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        own.alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(own, weights).alias("shard"),
        shard_of(own, [*weights, next_weight]).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(BUCKETS)).cast("int"))
    counts = out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most BUCKETS rows a shard
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size"))
    return out.withColumn("rank", rank).join(before, ["shard", "bucket"]).select("row", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"), "grown_shard")
