"""Sharding by rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) whose score for the key is highest; score = -weight / ln(u), u from a hash of key and shard.

    Only the key, the shard numbers and their weights decide.  A new shard wins just the keys for which its
    own score is the highest, so rows only move into it; a row moves with chance weight / total weight, and
    never between shards whose weights stay.  A shard of weight 0 gets nothing.  Equal scores go to the
    larger u, then to the highest number.  A null key is a key of its own.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be 0 or more, one of them above 0")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def score(i: int) -> list[Column]:
        top = F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 11)
        if even:  # the order of u is that of the score
            return [top.alias("u")]
        u = (top + F.lit(0.5)) / F.lit(float(1 << 53))
        return [(F.lit(-float(weights[i])) / F.log(u)).alias("s"), top.alias("u")]

    used = [i for i, w in enumerate(weights) if w > 0]
    even = len({weights[i] for i in used}) == 1
    if len(used) == 1:
        return F.lit(used[0])
    return F.greatest(*[F.struct(*score(i), F.lit(i).alias("i")) for i in used])["i"]


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40, name: str = "shard") -> DataFrame:
    """All rows and columns plus the shard; row-local, so nothing is shuffled.  A column named like ``name`` is replaced."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def add_slots(df: DataFrame, shard: str, order: Sequence[str], name: str = "slot", buckets: int = 64) -> DataFrame:
    """Gapless positions from 0 within each shard.

    Rows are numbered within (shard, hash bucket) and moved up by the sizes of the buckets before, so a
    shard of any size is numbered by ``buckets`` tasks.  Bucket sizes: shards x buckets rows.  Rows equal in
    ``order`` are interchangeable.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = b.groupBy(shard, "_b").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    row = F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    at = b.withColumn("_row", row).join(start, [shard, "_b"])
    return at.withColumn(name, F.col("_row") + F.col("_start") - 1).drop("_b", "_row", "_start")


def shard_table(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of a sharding by equal weights: key, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text (null: none) plus 16; the checksum of a null text is that of the empty one.
    ``grown_shard`` is the shard if there were one more.  Equal texts go where their keys send them.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), [1.0] * shards).alias("shard"),
        rendezvous(F.col(key), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return add_slots(rows, "shard", [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
