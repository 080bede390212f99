"""Citation files to one compact table with a manifest of where each file starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.citation_files import list_files
from citeloom.sources.packed import PACKED_BYTES, numeric_name_filter, pack_compact, pack_manifest, packed_ranges, write_packed_index


def pack_files(
    spark: SparkSession, files_path: str, packed_path: str, index_path: str, places_path: str | None = None, packed_bytes: int = PACKED_BYTES
) -> None:
    """Citation files to a compact table at ``packed_path`` and a manifest at ``index_path``;
    with ``places_path`` also the index that ``packed_lookup`` searches."""
    files = list_files(spark, files_path)
    pack_compact(spark, files_path, packed_path, packed_bytes, files)
    if places_path is not None:
        write_packed_index(spark, packed_path, places_path)
    pack_manifest(files_by_number(files)).write.option("compression", "bzip2").text(index_path)


def files_by_number(files: DataFrame) -> DataFrame:
    """Sizes of the numbered files. Spark writes a folder ``file=<number>`` per
    number, so parts of one number are added up under the name of the number."""
    number = F.regexp_extract("path", r"/file=(\d+)/[^/]*$", 1)
    return (
        files.select(F.concat(number, F.lit(".xml.bz2")).alias("path"), "length")
        .groupBy("path")
        .agg(F.sum("length").alias("length"))
    )


def load_ranges(spark: SparkSession, index_path: str, data_len: int) -> DataFrame:
    return packed_ranges(spark.read.text(index_path).withColumnRenamed("value", "line"), data_len)


def data_length(files: DataFrame) -> int:
    return numeric_name_filter(files).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
