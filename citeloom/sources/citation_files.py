"""Citation files: one XML file set per block number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import broadcast_small, stage

# Fixed values.
FILE_SUFFIX = ".xml.bz2"
NUMBER_WIDTH = 7

CITATION_SCHEMA = "_VALUE string, _id bigint, _uri string, _escaped boolean"

# Characters that XML cannot hold, or that its readers change.
_LOST = [chr(c) for c in (*range(0x20), 0xFFFE, 0xFFFF) if chr(c) not in "\t\n"]
_LOST_IN_ATTRIBUTES = [*_LOST, "\t", "\n"]


def file_name(number: F.Column) -> F.Column:
    """Padded to seven digits; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) < NUMBER_WIDTH, F.lpad(digits, NUMBER_WIDTH, "0")).otherwise(digits), F.lit(FILE_SUFFIX))


def file_stem(path: F.Column) -> F.Column:
    """File name without folder and the two suffixes; null for other files."""
    return F.nullif(F.regexp_extract(path, r"([^/]*)\.xml\.bz2$", 1), F.lit(""))


def _needs_escape(text: Column, lost: list[str]) -> Column:
    return F.rlike(text, F.lit("[" + "".join(f"\\u{ord(c):04X}" for c in lost) + "]"))


def _escaped(text: Column, lost: list[str]) -> Column:
    """Backslashes doubled, lost characters by their code behind one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char in lost:
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return text


def _unescaped(text: Column, lost: list[str]) -> Column:
    def part(piece: Column) -> Column:
        for char in lost:
            piece = F.replace(piece, F.lit(f"\\u{ord(char):04x}"), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def citation_xml_write(citations: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """``citation_id, file_number, uri, sentence`` as XML, one folder per number.

    A number with more rows than ``rows_per_file`` is written as several files by several
    tasks. Texts are shuffled once: the numbers with several files come as a slim table.
    A citation with a character that XML cannot hold is marked and escaped.
    """
    sizes = citations.groupBy("file_number").agg(F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int").alias("_files"))
    several = broadcast_small(stage(sizes.where("_files > 1"), "several"))
    split = F.pmod(F.xxhash64("citation_id"), F.coalesce("_files", F.lit(1)))
    odd = _needs_escape(F.col("sentence"), _LOST) | _needs_escape(F.col("uri"), _LOST_IN_ATTRIBUTES)
    spread = citations.join(several, "file_number", "left").withColumn("_split", split).withColumn("_odd", F.coalesce(odd, F.lit(False)))
    rows = spread.repartition("file_number", "_split").sortWithinPartitions("file_number").select(
        F.regexp_replace(file_name(F.col("file_number")), r"\.xml\.bz2$", "").alias("file"),
        F.when(F.col("_odd"), _escaped(F.col("uri"), _LOST_IN_ATTRIBUTES)).otherwise(F.col("uri")).alias("_uri"),
        F.col("citation_id").alias("_id"),
        F.when(F.col("_odd"), True).alias("_escaped"),
        F.when(F.col("_odd"), _escaped(F.col("sentence"), _LOST)).otherwise(F.col("sentence")).alias("_VALUE"),
    )
    (
        rows.write.partitionBy("file")
        .format("xml")
        .options(rowTag="citation", rootTag="citations", compression="bzip2", declaration='version="1.0" encoding="UTF-8"')
        .save(path)
    )


def citation_xml_read(spark: SparkSession, path: str, keep_path: str | None = None) -> DataFrame:
    """All citations of the files below ``path``, with the file number of the folder,
    and with the file's path in the column ``keep_path``."""
    rows = (
        spark.read.format("xml")
        .schema(CITATION_SCHEMA + ", file string")
        .options(rowTag="citation", ignoreSurroundingSpaces="false")
        .load(path)
    )
    origin = [F.col("_metadata.file_path").alias(keep_path)] if keep_path else []
    sentence = F.coalesce("_VALUE", F.lit(""))
    return rows.select(
        *origin,
        F.col("file").cast("bigint").alias("file_number"),
        F.col("_id").alias("citation_id"),
        F.when(F.col("_escaped"), _unescaped(F.col("_uri"), _LOST_IN_ATTRIBUTES)).otherwise(F.col("_uri")).alias("uri"),
        F.when(F.col("_escaped"), _unescaped(sentence, _LOST)).otherwise(sentence).alias("sentence"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of every file below ``path``; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spelled as ``citation_xml_read`` spells it, for joins on the path.
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def file_manifest(files: DataFrame) -> DataFrame:
    """Highest file number and total bytes of ``path, length`` rows whose name is a
    number; zero for no files."""
    number = file_stem(F.col("path")).try_cast("bigint")
    return files.where(number.isNotNull()).agg(
        F.coalesce(F.max(number), F.lit(0)).alias("last_file_number"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
    )
