"""Many small citation files as one: offsets, lengths, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.ordered import with_next, with_running_total
from citeloom.session import broadcast_small, stage
from citeloom.sources.citation_files import citation_xml_read, file_stem, list_files

# Compressed citation files that make one packed file.
PACKED_BYTES = 64 << 20

PACKED_SCHEMA = "file_number bigint, citation_id bigint, uri string, sentence string"


def numeric_name_filter(files: DataFrame) -> DataFrame:
    """Files whose name is a number; adds ``file_number``."""
    return files.withColumn("file_number", file_stem(F.col("path")).try_cast("bigint")).where("file_number is not null")


def pack_offsets(files: DataFrame) -> DataFrame:
    """``path, length`` rows in order of name; adds ``file_number`` and
    ``start_offset``, the total length of the files before it."""
    return with_running_total(numeric_name_filter(files), ["path"], "length", "start_offset")


def pack_manifest(files: DataFrame) -> DataFrame:
    """Index lines ``number:offset``."""
    offsets = pack_offsets(files)
    return offsets.select(F.concat_ws(":", "file_number", "start_offset").alias("line"))


def packed_ranges(lines: DataFrame, data_len: int) -> DataFrame:
    """Index lines back to ``file_number, start_offset, length``; the last file ends
    at the data's length."""
    parts = F.split("line", ":")
    offsets = lines.select(
        parts[0].cast("bigint").alias("file_number"), parts[1].cast("bigint").alias("start_offset")
    )
    # File number settles the order of empty files, which share their offset.
    ended = with_next(offsets, ["start_offset", "file_number"], "start_offset", "_next")
    length = F.coalesce("_next", F.lit(data_len)) - F.col("start_offset")
    return ended.select("file_number", "start_offset", length.alias("length"))


def pack_compact(spark: SparkSession, files_path: str, packed_path: str, packed_bytes: int = PACKED_BYTES, files: DataFrame | None = None) -> None:
    """Citations of many small files as few large ones, in order of file number.

    Which large file a small one goes to follows from the sizes of the files before it,
    so the citations are read once and each output has about ``packed_bytes``. Files of
    one number may go to different outputs. ``files`` is the list of them, where it is known:
    each listing is sent to the driver.
    """
    files = list_files(spark, files_path) if files is None else files
    placed = with_running_total(files, ["path"], "length", "_start")
    target = placed.select(F.col("path").alias("_path"), F.floor(F.col("_start") / F.lit(packed_bytes)).cast("int").alias("_target"))
    outputs = target.agg(F.coalesce(F.max("_target"), F.lit(0)) + 1).first()[0]
    rows = citation_xml_read(spark, files_path, keep_path="_path").join(broadcast_small(target), "_path")
    # By number, not by hash: each target is one task's.
    spread = rows.repartitionById(outputs, "_target").sortWithinPartitions("_target", "file_number", "citation_id")
    spread.drop("_path", "_target").write.parquet(packed_path)


def packed_index(spark: SparkSession, packed_path: str) -> DataFrame:
    """``file_number, data_file, first_row, n_rows``: where the citations of a number lie. One
    row per number and packed file it is in; only the numbers are read."""
    rows = spark.read.schema("file_number bigint").parquet(packed_path)
    placed = rows.select("file_number", F.col("_metadata.file_path").alias("data_file"), F.col("_metadata.row_index").alias("row"))
    return placed.groupBy("file_number", "data_file").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows"))


def write_packed_index(spark: SparkSession, packed_path: str, index_path: str) -> None:
    """In order of number, so that a search reads few row groups."""
    packed_index(spark, packed_path).repartitionByRange("file_number").sortWithinPartitions("file_number").write.parquet(index_path)


def packed_lookup(spark: SparkSession, index_path: str, numbers: list[int] | DataFrame) -> DataFrame:
    """Citations of the file numbers (a list, or a table with ``file_number``), from the packed
    files that hold one of them; no other file is opened. ``index_path`` is what
    ``write_packed_index`` wrote."""
    index = spark.read.parquet(index_path)
    if isinstance(numbers, list):
        found = index.where(F.col("file_number").isin(numbers))
    else:
        numbers = stage(numbers.select("file_number").distinct(), "numbers")
        found = index.join(numbers, "file_number", "left_semi")
    # As many as packed files at most, which are few by design.
    files = [r.data_file for r in found.select("data_file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], PACKED_SCHEMA)
    rows = spark.read.schema(PACKED_SCHEMA).parquet(*files)
    if isinstance(numbers, list):
        return rows.where(F.col("file_number").isin(numbers))
    return rows.join(broadcast_small(numbers), "file_number", "left_semi")
