"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; there is no ring
table to keep. Growing from n to n + 1 shards moves about one row in n + 1, and only
into the new shard (Lamping and Veach, 2014).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import shuffle_partitions, stage, utf8_size

#: Copies of one (key, size, checksum) that one task numbers at a time.
COPIES_PER_ROW = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(going):
            shard[going] = jump[going]
            state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[going] = ((shard[going] + 1).astype(np.float64) * step).astype(np.int64)
            going = going[jump[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit integer key; a null key counts as 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return place(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def placement(
    df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets_per_shard: int | None = None
) -> DataFrame:
    """One row per row of ``df``: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 8; a null text counts as empty. A null key counts
    as 0 and stays null in the result. ``slot`` numbers the rows of a shard from 0 without
    gaps, by bucket, key, checksum and size; rows that repeat all three are alike, so it
    does not matter which of their slots each gets. An empty table gives no rows.

    Text is read once; only key, size and checksum are shuffled. A shard is numbered in
    hashed buckets, so that no task holds a shard. Equal rows are counted before the
    shuffle and expanded after it, in runs of bounded length.
    """
    spark = df.sparkSession
    buckets = buckets_per_shard or max(64, math.ceil(8 * shuffle_partitions(spark) / shards))
    slim = df.select(
        F.col(key).cast("bigint").alias("doc_id"),
        (utf8_size(F.col(text)) + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    groups = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = groups.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    placed = stage(placed, "placement")

    # shards * buckets rows: a bound that does not grow with the table.
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_bucket")
        .agg(F.sum("_n").alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    before = (
        Window.partitionBy("shard", "_bucket")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        placed.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(COPIES_PER_ROW).cast("bigint"))))
        .repartition("doc_id", "text_crc32", "_first")
        .withColumn("_last", F.least(F.col("_n"), F.col("_first") + COPIES_PER_ROW) - 1)
        .withColumn("_copy", F.explode(F.sequence("_first", "_last")))
    )
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_offset") + F.col("_before") + F.col("_copy")).cast("bigint").alias("slot"),
        "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """``df`` as Parquet below ``path``, one folder ``shard=n`` for each shard."""
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
