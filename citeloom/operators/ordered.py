"""Whole-table order without a one-task window.

A window with no partition key runs on a single task. Here the rows are
range-partitioned on their order, staged in the shared folder, and numbered by
(partition, position). What has to cross partitions - counts, sums, first rows - is
one row per partition, so the only unpartitioned window sees at most as many rows as
there are shuffle partitions. A table whose estimated size is small (``SMALL_BYTES``) takes
the plain window instead, which saves the staging.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.session import broadcast_small, plan_bytes, stage

_POSITION_BITS = 33

# Estimated size up to which one task may order the whole table.
SMALL_BYTES = 8 << 20


def ordered_parts(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    """``df`` with ``_part`` and ``_idx``: ordered over the pair as asked for, or in
    scan order for ``order_by=None``. Staged, so that both stay as they are when a lost
    executor makes tasks run again."""
    if order_by is not None:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    numbered = df.withColumn("_pos", F.monotonically_increasing_id())
    return stage(
        numbered.withColumn("_part", F.shiftright("_pos", _POSITION_BITS))
        .withColumn("_idx", F.col("_pos").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_pos"),
        "ordered",
    )


def assign_ids(
    df: DataFrame,
    id_col: str,
    start_after: int = 0,
    order_by: Sequence[str] | None = None,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Dense ids ``start_after + 1, ...``.

    ``order_by`` must name columns that are unique together, so that one hot value
    cannot fill a partition.
    """
    if order_by is not None and plan_bytes(df) <= small_bytes:
        place = F.row_number().over(Window.orderBy(*order_by))
        return df.withColumn(id_col, (F.lit(start_after) + place).cast("bigint"))
    parts = ordered_parts(df, order_by)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    new_id = F.lit(start_after) + F.col("_offset") + F.col("_idx") + 1
    # One row per partition: small enough to broadcast whatever the table's size.
    return parts.join(F.broadcast(offsets), "_part").select(*df.columns, new_id.cast("bigint").alias(id_col))


def read_with_ids(spark: SparkSession, path: str, id_col: str, start_after: int = 0) -> DataFrame:
    """A staged Parquet table with dense ids in the order of its files and rows.

    Ids come from (file, row number in the file), so they do not depend on how the
    files are split into tasks, and numbering neither shuffles nor rewrites a row.
    """
    table = spark.read.parquet(path)
    columns = table.columns
    files = table.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    new_id = F.lit(start_after) + F.col("_offset") + F.col("_row") + 1
    rows = table.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(broadcast_small(offsets), "_file").select(*columns, new_id.cast("bigint").alias(id_col))


def with_next(
    df: DataFrame, order_by: Sequence[str], column: str, out: str, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """``out`` = ``column`` of the next row in the whole order, null on the last row."""
    if plan_bytes(df) <= small_bytes:
        return df.withColumn(out, F.lead(column).over(Window.orderBy(*order_by)))
    parts = ordered_parts(df, order_by)
    heads = (
        parts.where("_idx = 0")
        .groupBy("_part")
        .agg(F.first(column).alias("_head"))
        .select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_next_head"))
    )
    inside = F.lead(column).over(Window.partitionBy("_part").orderBy("_idx"))
    last = F.row_number().over(Window.partitionBy("_part").orderBy("_idx")) == F.count("*").over(
        Window.partitionBy("_part")
    )
    return (
        parts.withColumn("_inside", inside)
        .withColumn("_last", last)
        .join(F.broadcast(heads), "_part", "left")
        .select(*df.columns, F.when(F.col("_last"), F.col("_next_head")).otherwise(F.col("_inside")).alias(out))
    )


def with_running_total(
    df: DataFrame, order_by: Sequence[str], column: str, out: str, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """``out`` = sum of ``column`` over all earlier rows of the whole order."""
    if plan_bytes(df) <= small_bytes:
        earlier = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(column).over(earlier), F.lit(0)).cast("bigint"))
    parts = ordered_parts(df, order_by)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(F.sum(column).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside_before = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(column).over(inside_before), F.lit(0))
    return (
        parts.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + F.col("_inside")).cast("bigint").alias(out))
    )
