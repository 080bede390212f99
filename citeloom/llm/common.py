"""Session settings and small helpers that the operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import session

# Texts vary from nothing to megabytes, so Arrow batches are bounded by bytes as well.
ARROW_BATCH_BYTES = "1m"


def prepare(spark: SparkSession) -> SparkSession:
    session.tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(total: float, each: float, spark: SparkSession) -> int:
    """Number of groups so that one holds about ``each`` of ``total``; at least one per
    shuffle partition."""
    return max(shuffle_partitions(spark), math.ceil(total / each))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, as tuples of Python values."""
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, each: int = 2000, weight: Callable[[tuple], int] | None = None, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of ``each`` rows, or fewer once ``weight`` sums to ``most``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= each or size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8_size(text) -> F.Column:
    """UTF-8 bytes of a text column, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def append_columns(df: DataFrame, text: str, added: dict[str, str], compute: Callable[[list[str | None]], Sequence[pa.Array]]) -> DataFrame:
    """``df`` with columns ``added`` (name to type) that ``compute`` makes from the texts of
    an Arrow batch. Row-local; a name that ``df`` has already is an error."""
    if taken := {c.lower() for c in df.columns} & {c.lower() for c in added}:
        raise ValueError(f"the table has columns {sorted(taken)} already")
    schema = df
    for name, kind in added.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [*batch.columns, *compute(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema.schema)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. The shuffle files behind it are deleted as soon
    as it is written, so that an operator of many steps needs the disk of one."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return session.stage(df, name)
    finally:
        conf.set(_CLEANUP, before)
