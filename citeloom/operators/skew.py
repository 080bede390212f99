"""Equi-join that stays even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import plan_bytes

# Up to this estimated size of both sides Spark's own join is even enough.
PLAIN_JOIN_BYTES = 16 << 20

# Keys with fewer joined rows than this are never worth spreading.
HOT_ROWS = 10_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str] | None = None,
    plain_bytes: int = PLAIN_JOIN_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of ``left`` with ``right`` on ``keys``, spread by its output.

    ``left_by`` and ``right_by`` name columns whose hash spreads the rows of one key;
    ``right_by=None`` says that ``right`` has one row per key.

    Rows per key are counted first; give staged tables. A key that makes more than a
    quarter of a fair partition's output is hot: the side with more rows of it is
    spread over salts, the rows of the other side are repeated once per salt. No row is
    dropped. By arithmetic there are at most four hot keys per shuffle partition, so
    their list is small; without any, the join is a plain one.
    """
    keys = list(keys)
    if max(plan_bytes(left), plan_bytes(right)) <= plain_bytes:
        return left.join(right, keys)

    counts = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_left"))
    if right_by is None:
        counts = counts.withColumn("_right", F.lit(1))
    else:
        counts = counts.join(right.groupBy(*keys).agg(F.count("*").alias("_right")), keys)
    counts = counts.withColumn("_rows", F.col("_left").cast("double") * F.col("_right"))
    slots = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = (counts.agg(F.sum("_rows")).first()[0] or 0) / slots
    hot = counts.where(F.col("_rows") > max(fair, hot_rows)).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.ceil(F.col("_rows") / F.lit(fair)).cast("int").alias("_salts"),
        (F.col("_left") >= F.col("_right")).alias("_spread_left"),
    )
    hot_list = hot.collect()
    if not hot_list:
        return left.join(right, keys)
    hot_keys = F.broadcast(left.sparkSession.createDataFrame(hot_list, hot.schema))

    def salted(df: DataFrame, spread_by: Sequence[str], spread_here: Column) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot_{k}") for k in keys])
        one = F.array(F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_salts") - 1)
        salts = F.when(F.col("_salts").isNull(), F.array(F.lit(0))).when(spread_here, one).otherwise(every)
        return df.join(hot_keys, on, "left").select(*df.columns, F.explode(salts).alias("_salt"))

    spread_left = salted(left, left_by, F.col("_spread_left"))
    spread_right = salted(right, right_by or keys, ~F.col("_spread_left"))
    return spread_left.join(spread_right, [*keys, "_salt"]).drop("_salt")
