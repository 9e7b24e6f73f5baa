"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws, from the key and its own name, a number u in (0, 1); the
record goes to the shard with the largest weight / -ln(u). A new shard can only
win records for itself, so that growing from n to n + 1 shards moves about
1 / (n + 1) of the records and none between old shards. All of it is built-in
expressions; no row leaves its partition to be placed.

A null key is a key of its own; a null text has no bytes and checksum 0. Repeated
rows are placed each, together. Slots number the rows of a shard from 0 without
gaps: rows are written once with the partition that wrote them, partitions get
their bases from counts by partition and shard, and rows are numbered within
these, so that no task grows with a shard or with a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import written


def _draw(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(f":{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.ln(u)


def draws_of(key: Column, weights: Sequence[float]) -> Column:
    """Each shard's draw of a key, with the shard's number."""
    return F.array(*[F.struct(_draw(key, k, w).alias("draw"), F.lit(-k).alias("k")) for k, w in enumerate(weights)])


def winner(draws: Column) -> Column:
    """Shard of the largest draw; equal draws go to the lower shard."""
    return -F.array_max(draws)["k"]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights) - 1 of a key."""
    return winner(draws_of(key, weights))


def with_slots(df: DataFrame, shard: str = "shard") -> DataFrame:
    """``df`` with ``slot``, gapless from 0 within each shard."""
    rows = written(df.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()), "slots")
    counts = rows.groupBy("_part", shard).agg(F.count("*").alias("_n"))
    # one row for each partition and shard
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("_part", shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "slot-bases")
    nth = F.row_number().over(Window.partitionBy("_part", shard).orderBy("_nth")) - 1
    return rows.withColumn("_k", nth).join(bases, ["_part", shard]).withColumn("slot", F.col("_base") + F.col("_k")).drop("_part", "_nth", "_base", "_k")


def shard_documents(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        draws_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).alias("draws"),
    )
    placed = rows.select("doc_id", "size", "text_crc32", "law", winner(F.slice("draws", 1, len(weights))).cast("int").alias("shard"), winner(F.col("draws")).cast("int").alias("grown_shard"))
    return with_slots(placed).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
