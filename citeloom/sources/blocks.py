"""The dump as a data source of its own: ``spark.read.format("dump_blocks").load(index)``.

``write_block_index`` makes the index once: one row per block with its range of article
ids, and the articles in order of title. A read plans its blocks from there. Filters on
``article_id`` and ``title`` go into that plan, so blocks that cannot hold a wanted page are
never opened; what is left of a filter Spark checks again on the rows.

Planning lists one small tuple per block to read, as Spark's own readers list files. Blocks
go to tasks by their compressed bytes. Files are read through the file system their path
names, at the offsets of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from citeloom.session import stage
from citeloom.sources.dump import PAGE_ID, TASK_BYTES, block_table, locate, pages_of_block

FORMAT = "dump_blocks"
SCHEMA = "dump_path string, block_start bigint, block_end bigint, article_id bigint, title string, markup string"
_ARROW = pa.schema(
    [
        ("dump_path", pa.string()),
        ("block_start", pa.int64()),
        ("block_end", pa.int64()),
        ("article_id", pa.int64()),
        ("title", pa.string()),
        ("markup", pa.string()),
    ]
)
_BATCH_CHARS = 8 << 20


def write_block_index(index: DataFrame, lengths: DataFrame, path: str) -> None:
    """``index``: ``dump_path, block_start, article_id, title``; ``lengths``: ``dump_path,
    data_len``. Two tables below ``path``, in order of what they are searched by, so that a
    search reads few row groups."""
    index = stage(index.select("dump_path", "block_start", "article_id", "title"), "index")
    ranges = index.groupBy("dump_path", "block_start").agg(F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))
    blocks = block_table(index, lengths).join(ranges, ["dump_path", "block_start"])
    blocks.repartitionByRange("first_id").sortWithinPartitions("first_id").write.mode("overwrite").parquet(f"{path}/blocks")
    # The article id keeps copies of one title from filling a partition.
    index.repartitionByRange("title", "article_id").sortWithinPartitions("title").write.mode("overwrite").parquet(f"{path}/articles")


@dataclass
class Blocks(InputPartition):
    """(path, start, end) of the blocks of one task."""

    spans: list[tuple[str, int, int]]


def _all(conditions: Sequence[pc.Expression]) -> pc.Expression | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


class BlockReader(DataSourceReader):
    def __init__(self, index_path: str, task_bytes: int, tasks: int = 1):
        self.index_path, self.task_bytes, self.tasks = index_path, task_bytes, tasks
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All are left to Spark as well: here they choose blocks and spare pages."""
        known = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.filters = [f for f in filters if isinstance(f, known) and f.attribute in (("article_id",), ("title",))]
        yield from filters

    def _values(self, column: str) -> list[list]:
        """The values that each filter for equality allows in a column."""
        found = [f for f in self.filters if f.attribute == (column,)]
        listed = [list(f.value) for f in found if isinstance(f, In)]
        return listed + [[f.value] for f in found if isinstance(f, (EqualTo, EqualNullSafe))]

    def _table(self, name: str, columns: list[str], condition: pc.Expression | None) -> pa.Table:
        filesystem, inner = locate(self.index_path)
        return ds.dataset(f"{inner}/{name}", format="parquet", filesystem=filesystem).to_table(columns=columns, filter=condition)

    def spans(self) -> list[tuple[str, int, int]]:
        """Blocks to open, in order of their place."""
        first, last = ds.field("first_id"), ds.field("last_id")
        limits = {
            GreaterThan: lambda v: last > v,
            GreaterThanOrEqual: lambda v: last >= v,
            LessThan: lambda v: first < v,
            LessThanOrEqual: lambda v: first <= v,
        }
        conditions = [limits[type(f)](f.value) for f in self.filters if type(f) in limits and f.attribute == ("article_id",)]
        for values in self._values("article_id"):
            within = [(first <= v) & (last >= v) for v in values if v is not None]
            conditions.append(reduce(lambda a, b: a | b, within, ds.scalar(False)))
        table = self._table("blocks", ["dump_path", "block_start", "block_end"], _all(conditions))
        spans = set(zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True))
        for values in self._values("title"):
            wanted = ds.field("title").isin(pa.array([v for v in values if v is not None], pa.string()))
            named = self._table("articles", ["dump_path", "block_start"], wanted)
            places = set(zip(*(named.column(c).to_pylist() for c in named.column_names), strict=True))
            spans = {s for s in spans if s[:2] in places}
        return sorted(spans)

    def partitions(self) -> list[Blocks]:
        parts: list[Blocks] = []
        held = 0
        spans = self.spans()
        most = min(self.task_bytes, -(-sum(end - start for _, start, end in spans) // self.tasks))
        for span in spans:
            size = span[2] - span[1]
            if not parts or held + size > most:
                parts.append(Blocks([]))
                held = 0
            parts[-1].spans.append(span)
            held += size
        return parts or [Blocks([])]

    def _wants(self, column: str, value: object) -> bool:
        return all(value in allowed for allowed in self._values(column))

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path, start, end in partition.spans:
            for xml in pages_of_block(path, start, end):
                found = PAGE_ID.search(xml)
                number = int(found.group(1)) if found else None
                if not self._wants("article_id", number):
                    continue
                title, markup = _page(xml)
                if self._wants("title", title):
                    rows.append((path, start, end, number, title, markup))
                    size += len(xml)
                if size >= _BATCH_CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _page(xml: str) -> tuple[str | None, str | None]:
    """Title and markup; null where the XML is broken or holds none."""
    try:
        page = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None, None
    text = page.find("revision/text")
    return page.findtext("title"), None if text is None else text.text or ""


class DumpBlocks(DataSource):
    """Options: ``path`` of the block index; ``taskBytes``, most compressed bytes per task;
    ``tasks``, how many tasks a small dump is dealt to at least."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)), int(self.options.get("tasks", 1)))


def register_blocks(spark: SparkSession) -> None:
    """Makes the format known to a session; filters reach it from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DumpBlocks)


def read_blocks(spark: SparkSession, index_path: str) -> DataFrame:
    """Pages of an indexed dump; filter on ``article_id`` and ``title`` to read few blocks."""
    register_blocks(spark)
    return spark.read.format(FORMAT).option("tasks", spark.sparkContext.defaultParallelism).load(index_path)
