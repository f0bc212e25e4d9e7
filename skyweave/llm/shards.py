"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import many_buckets, ranked, stored, uniform

#: Rows of the sums by shard and bucket up to which these are broadcast.
BROADCAST_ROWS = 262_144


def race(key: Column, shard: int, weight: float) -> Column:
    """The time at which `shard` would finish in an exponential race for the record; the first wins.

    A digest of key and shard makes a uniform number in (0, 1); -ln(u) / weight makes a shard of twice the
    weight win twice as often. The time depends on the key and this shard alone, so another shard that
    joins can only take records, never pass them between the others.
    """
    return -F.log(uniform(key, str(shard))) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard (int), smallest number on a tie."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, at least one")
    return F.array_min(F.array(*[F.struct(race(key, s, w).alias("t"), F.lit(s).alias("s")) for s, w in enumerate(weights)]))["s"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Every row of docs with shard, slot (gapless from 0 in each shard), size, text_crc32 and grown_shard.

    Key: doc_id alone; a null doc_id is a key like any other. Size: UTF-8 bytes of the text plus 1; a null
    text has none, so size 1 and the checksum of no bytes, as an empty one. Rows repeated in full lie in
    one shard, in slots of their own. An empty table gives an empty result. Extra columns are not read.
    Slots follow a digest of doc_id and text, so many rows of one key are no single task. grown: weights of the shard set to compare with (null result where None).
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = stored(docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        uniform(F.concat_ws(":", key, F.crc32(text)), "slot").alias("order"),
    ), "shards")
    buckets = many_buckets(slim.count() // len(weights) + 1)
    return ranked(slim, ["shard"], ["order", "doc_id", "text_crc32", "size"], F.floor(F.col("order") * buckets), "slot", few=len(weights) * buckets <= BROADCAST_ROWS).drop("order")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """Write docs, all columns kept, into one folder for each shard. No shuffle: each task writes its rows of every shard."""
    docs.withColumn("shard", shard_of(F.col("doc_id"), weights)).write.partitionBy("shard").parquet(path)
