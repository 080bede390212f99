"""Dump and index: index lines, blocks, pages.

A dump is a bz2 file of many members ("blocks", about 100 pages each); the index
names block start, article id and title per page. Large dumps come in several files,
so rows carry ``dump_path``.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.ordered import with_next
from citeloom.operators.skew import salted_join
from citeloom.session import broadcast_small

# Fixed values.
INDEX_LINE = r"^(\d+):(\d+):(.*)$"
PAGE_END = "</page>"
PAGE_SCHEMA = "id bigint, title string, revision struct<text string>"

# Wanted ids per row of the block reader, a few megabytes. A usual block has a hundred;
# one with more than this is unpacked once per chunk.
WANTED_PER_CHUNK = 100_000

# Compressed bytes per task of the block reader.
TASK_BYTES = 32 << 20
_READ_BYTES = 1 << 20
_BATCH_BYTES = 8 << 20


def index_parse(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``offset:id:title`` lines; the title keeps further colons. Lines of another
    shape give nulls, see ``index_rejects``."""
    line = F.col(line_col)
    kept = [c for c in lines.columns if c != line_col]
    return lines.select(
        *kept,
        F.regexp_extract(line, INDEX_LINE, 1).try_cast("bigint").alias("block_start"),
        F.regexp_extract(line, INDEX_LINE, 2).try_cast("bigint").alias("article_id"),
        F.regexp_extract(line, INDEX_LINE, 3).alias("title"),
    )


def index_rejects(lines: DataFrame, line_col: str = "value") -> DataFrame:
    return lines.where(~F.rlike(line_col, F.lit(INDEX_LINE)))


def read_index(spark: SparkSession, path: str, dump_path: str) -> DataFrame:
    """Index file(s) of one dump file; bz2 is read as is. ``dump_path`` may be spelled in
    any way that Spark can read; it is stored as the file system spells it."""
    where = F.lit(qualified_path(spark, dump_path)).alias("dump_path")
    return index_parse(spark.read.text(path)).select(where, "block_start", "article_id", "title")


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path as its file system spells it, with scheme and authority; a local one
    without. ``dump_lengths`` spells paths the same way."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        target = system.getFileStatus(target).getPath()
    return re.sub("^file:/+", "/", system.makeQualified(target).toString())


def block_table(index: DataFrame, lengths: DataFrame) -> DataFrame:
    """``dump_path, block_start, block_end, n_articles``.

    A block ends where the next one of its file starts, the last at the file's length
    (``lengths``: ``dump_path, data_len``, one row per dump file). A file without a length
    is an error: the paths of index and lengths differ, or the file is not there.
    """
    blocks = index.groupBy("dump_path", "block_start").agg(F.count("*").alias("n_articles"))
    blocks = blocks.withColumn("_here", F.struct("dump_path", "block_start"))
    ended = with_next(blocks, ["dump_path", "block_start"], "_here", "_next")
    same_file = F.col("_next.dump_path") == F.col("dump_path")
    missing = F.raise_error(F.concat(F.lit("no length is known of dump file "), "dump_path")).cast("bigint")
    file_end = F.when(F.col("data_len").isNull(), missing).otherwise(F.col("data_len"))
    return ended.join(broadcast_small(lengths), "dump_path", "left").select(
        "dump_path",
        "block_start",
        F.when(same_file, F.col("_next.block_start")).otherwise(file_end).alias("block_end"),
        "n_articles",
    )


def articles_per_block(index: DataFrame, blocks: DataFrame, per_chunk: int = WANTED_PER_CHUNK) -> DataFrame:
    """Article lists per block: the columns of ``blocks``, ``chunk_no`` and
    ``articles``. A block of usual size is one row; a very large one is spread over
    chunks by article id, so that no list grows without bound."""
    chunks = F.ceil(F.col("n_articles") / F.lit(per_chunk))
    return (
        salted_join(index, blocks, ["dump_path", "block_start"], ["article_id"])
        .withColumn("chunk_no", F.pmod(F.xxhash64("article_id"), chunks).cast("int"))
        .groupBy(*blocks.columns, "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct("article_id", "title"))).alias("articles"))
    )


def dump_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``dump_path, data_len`` of the files below ``path``; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("dump_path"), F.col("length").alias("data_len"))


def _parse_pages(df: DataFrame, xml_col: str) -> DataFrame:
    """Raw page XML to ``page`` (null id when the XML is broken).

    The parsed page is an exploded one-element array: filters on its fields then stay
    above it, where they would otherwise be pushed down and parse the page again.
    """
    page = F.from_xml(F.col(xml_col), PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    kept = [c for c in df.columns if c != xml_col]
    return df.select(*kept, F.explode(F.array(page)).alias("page"))


def dump_read(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a dump: ``article_id, title, markup``.

    The text source splits a bz2 file over many tasks; the XML source would read a
    whole dump file in one.
    """
    raw = spark.read.option("lineSep", PAGE_END).text(path)
    return pages_from_text(raw)


PAGES_SCHEMA = "article_id bigint, title string, markup string"


def pages_from_text(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pages from text rows that were cut at the end tag of each page, with the columns
    ``keep`` of the rows."""
    start = F.instr("value", "<page>")
    xml = F.concat(F.substr("value", start), F.lit(PAGE_END))
    pages = _parse_pages(raw.where(start > 0).select(*keep, xml.alias("xml")), "xml")
    return pages.select(
        *keep, F.col("page.id").alias("article_id"), F.col("page.title").alias("title"), F.col("page.revision.text").alias("markup")
    )


#: Schemes that pyarrow spells otherwise than Hadoop does.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


PAGE_ID = re.compile(r"<id>\s*(\d+)\s*</id>")


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names, and the path in it. Blocks are read at their
    offsets, which Spark's own readers cannot do, so the scheme must be one that pyarrow
    knows as well."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" or not (colon and rest.startswith("//")):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    try:
        return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowException, ValueError) as unknown:
        raise ValueError(f"cannot open {path} at an offset: copy the dump to a file, s3, gs, abfs or hdfs path") from unknown


def pages_of_block(path: str, start: int, end: int) -> Iterator[str]:
    """Raw page XML of one block, decompressed piece by piece."""
    unpacker, pending = bz2.BZ2Decompressor(), b""
    filesystem, inner = locate(path)
    with filesystem.open_input_file(inner) as file:
        file.seek(start)
        left = end - start
        while left > 0:
            data = file.read(min(_READ_BYTES, left))
            if not data:
                raise EOFError(f"{path}: block {start} to {end} is cut short")
            left -= len(data)
            while data:
                if unpacker.eof:
                    unpacker = bz2.BZ2Decompressor()
                pending += unpacker.decompress(data)
                data = unpacker.unused_data if unpacker.eof else b""
            *pages, pending = pending.split(b"</page>")
            for page in pages:
                at = page.find(b"<page>")
                if at >= 0:
                    yield (page[at:] + b"</page>").decode("utf-8", errors="replace")


def _read_blocks(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Block rows to page rows; ``carried`` columns are copied onto each page."""
    for batch in batches:
        types = [batch.schema.field(c).type for c in carried] + [pa.int64(), pa.string(), pa.string()]
        names = [*carried, "article_id", "title", "xml"]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, size = [], 0
        for block in batch.to_pylist():
            titles = {a["article_id"]: a["title"] for a in block["articles"]}
            where = tuple(block[c] for c in carried)
            for xml in pages_of_block(block["dump_path"], block["block_start"], block["block_end"]):
                found = PAGE_ID.search(xml)
                number = int(found.group(1)) if found else None
                if number in titles:
                    rows.append((*where, number, titles.pop(number), xml))
                    size += len(xml)
                if size >= _BATCH_BYTES:
                    yield pack(rows)
                    rows, size = [], 0
            # Indexed pages the block does not hold stay visible, without text.
            rows += [(*where, number, title, None) for number, title in titles.items()]
        if rows:
            yield pack(rows)


def dump_read_blocks(articles_by_block: DataFrame) -> DataFrame:
    """Only the wanted pages, from only the blocks that hold them.

    ``articles_by_block`` is the output of ``articles_per_block`` over the wanted
    index rows. The list travels to the block, so page text is never joined or
    shuffled. It should be a staged table, as it is read twice. Returns the block columns, ``article_id``, ``title`` and ``markup``,
    which is null for a page that is indexed but missing.
    """
    spark = articles_by_block.sparkSession
    fields = [f for f in articles_by_block.schema.fields if f.name not in ("articles", "chunk_no")]
    carried = [f.name for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def read(batches):
        return _read_blocks(batches, carried)

    # A fixed number of tasks by the bytes to read: the rows themselves are so small
    # that an adaptive shuffle would put all of them into one task.
    compressed = articles_by_block.agg(F.coalesce(F.sum(F.col("block_end") - F.col("block_start")), F.lit(0))).first()[0]
    least = spark.sparkContext.defaultParallelism
    spread = articles_by_block.repartition(max(least, -(-compressed // TASK_BYTES)), "dump_path", "block_start", "chunk_no")
    pages = _parse_pages(spread.mapInArrow(read, f"{schema}, article_id bigint, title string, xml string"), "xml")
    return pages.withColumn("markup", F.col("page.revision.text")).drop("page")


def index_join_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Indexed articles with the markup of their page."""
    return index.join(pages.select("article_id", "markup"), "article_id")


def index_misses(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Indexed articles whose page is missing."""
    return index.join(pages.select("article_id"), "article_id", "left_anti")
