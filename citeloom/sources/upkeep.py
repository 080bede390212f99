"""Upkeep of a store that grows by runs: small runs become few, larger ones.

Runs are merged by size tier, so that a row is rewritten about once per tier, as often as the
logarithm of the store's size. A merge writes its runs beside the others, unseen; creating
the next file of the store's list of merges is what makes readers see the merged run in place
of its parts. The parts stay until ``vacuum``, for readers that began before.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.numbered import create_text, delete, exists, last_number, numbered, read_text
from citeloom.sources.outcomes import OUTCOMES_SCHEMA
from citeloom.sources.stores import CITATIONS_SCHEMA, MERGED, TOPICS_SCHEMA, current_merge, ensure_folder

#: Runs of a tier differ in size by less than this.
TIER = 8

#: Bytes below which runs are of one tier, and of one file that a merge writes.
SMALL_BYTES, FILE_BYTES = 8 << 20, 256 << 20

TABLES = {"outcomes": OUTCOMES_SCHEMA, "citations": CITATIONS_SCHEMA, "topics": TOPICS_SCHEMA}


def run_sizes(spark: SparkSession, store: str) -> DataFrame:
    """``folder, bytes`` of the finished run folders that count; files are listed, not read."""
    merges = current_merge(spark, store)
    gone = [run for runs in merges.values() for run in runs]
    sizes = None
    for name in TABLES:
        if not exists(spark, f"{store}/{name}"):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{store}/{name}")
        found = files.select(F.regexp_extract("path", r"/run=([^/]*)/[^/]*$", 1).alias("folder"), F.lit(name).alias("table"), "length")
        sizes = found if sizes is None else sizes.unionByName(found)
    if sizes is None:
        return spark.createDataFrame([], "folder string, bytes bigint")
    sizes = sizes.groupBy("folder").agg(F.sum("length").alias("bytes"), F.max(F.col("table") == "topics").alias("finished"))
    counts = ~F.startswith("folder", F.lit(MERGED)) | F.col("folder").isin(list(merges))
    return sizes.where(F.col("finished") & counts & ~F.col("folder").isin(gone)).select("folder", "bytes")


def _tier(size: int) -> int:
    return 0 if size < SMALL_BYTES else 1 + int(math.log(size / SMALL_BYTES, TIER))


def _merge_folders(spark: SparkSession, store: str, folders: list[str], size: int) -> str:
    """Writes one run from several; nobody sees it yet. Topics come last, as always."""
    name = f"{MERGED}{uuid.uuid4().hex}"
    files = max(1, -(-size // FILE_BYTES))
    for table, schema in TABLES.items():
        path = f"{store}/{table}"
        if not exists(spark, path):
            continue
        rows = spark.read.schema(f"{schema}, own_run string, run string").parquet(path).where(F.col("run").isin(folders))
        rows = rows.withColumn("own_run", F.coalesce("own_run", "run")).drop("run")
        order = {"topics": "topic_id", "citations": "topic_id", "outcomes": "article_id"}[table]
        # The second column keeps one topic's citations from filling a file.
        by = [order, "citation_id"] if table == "citations" else [order]
        rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(f"{path}/run={name}")
    return name


def merge_runs(spark: SparkSession, store: str, least: int = 8) -> int:
    """Merges the runs of every tier that has ``least`` of them; returns how many runs went.

    Safe beside writers of other runs, and beside another merge: the one that comes second
    takes back what it wrote. Runs of which one may still be repeated are fine: the repeated
    run has the ids it had and stays behind its merge.
    """
    number = last_number(spark, f"{store}/merges")
    before = json.loads(read_text(spark, numbered(f"{store}/merges", number))) if number else {}
    sizes = {r.folder: r.bytes for r in run_sizes(spark, store).collect()}
    tiers: dict[int, list[str]] = {}
    for folder, size in sorted(sizes.items()):
        tiers.setdefault(_tier(size), []).append(folder)
    ready = [folders for folders in tiers.values() if len(folders) >= least]
    if not ready:
        return 0
    now, made = dict(before), []
    for folders in ready:
        name = _merge_folders(spark, store, folders, sum(sizes[f] for f in folders))
        made.append(name)
        # Merged runs that are merged again stand for nothing by themselves any more.
        now[name] = folders + [part for f in folders for part in now.pop(f, [])]
    ensure_folder(spark, f"{store}/merges")
    if not create_text(spark, numbered(f"{store}/merges", number + 1), json.dumps(now)):
        for name in made:
            for table in TABLES:
                delete(spark, f"{store}/{table}/run={name}")
        return 0
    return sum(map(len, ready))


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes the folders that merges have replaced; returns how many runs went. Call it
    when no reader is left that began before the last merge."""
    gone = [run for runs in current_merge(spark, store).values() for run in runs]
    for run in gone:
        for table in TABLES:
            delete(spark, f"{store}/{table}/run={run}")
    return len(gone)
