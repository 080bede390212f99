"""The two stored tables, topics and citations, as Parquet that grows by runs.

Each run writes ``run=<id>`` folders, citations first and topics last, and overwrites
its own folders when it is repeated. Readers only take the citations of runs that have
topics, so a run that died in between leaves nothing visible.

Small runs are merged now and then (``sources.upkeep``) into runs that keep each row's own
run beside it. Which merged runs stand for which others is told by the newest file of a
numbered list: creating it is the swap, and readers see either all of a merge or nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import broadcast_small
from citeloom.sources.numbered import exists, last_number, numbered, read_text, target_of

TOPICS_SCHEMA = (
    "topic_id bigint, name string, block_start bigint, block_end bigint, article_id bigint, topic_vector array<float>"
)
CITATIONS_SCHEMA = (
    "citation_id bigint, topic_id bigint, file_number bigint, uri string, sentence string, paragraph string"
)


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def write_run(df: DataFrame, path: str, run: str, schema: str) -> None:
    df.select(*_columns(schema)).write.mode("overwrite").parquet(f"{path}/run={run}")


def ensure_folder(spark: SparkSession, path: str) -> None:
    system, target = target_of(spark, path)
    system.mkdirs(target)


#: Merged runs are named so; they count once the newest merge lists them.
MERGED = "merged-"


def current_merge(spark: SparkSession, store: str) -> dict[str, list[str]]:
    """``{merged run: runs it stands for}`` as of now."""
    folder = f"{store}/merges"
    number = last_number(spark, folder)
    return json.loads(read_text(spark, numbered(folder, number))) if number else {}


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table ``<store>/<name>`` that count, each with its ``run``."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, run string")
    store = path.rpartition("/")[0]
    merges = current_merge(spark, store)
    rows = spark.read.schema(f"{schema}, own_run string, run string").parquet(path)
    # The folder's name decides, so folders that do not count are never opened.
    counts = ~F.startswith("run", F.lit(MERGED)) | F.col("run").isin(list(merges))
    replaced = [run for runs in merges.values() for run in runs]
    if replaced:
        counts = counts & ~F.col("run").isin(replaced)
    return rows.where(counts).select(*_columns(schema), F.coalesce("own_run", "run").alias("run"))


def topics_write(topics: DataFrame, store: str, run: str) -> None:
    write_run(topics, f"{store}/topics", run, TOPICS_SCHEMA)


def topics_withdraw(spark: SparkSession, store: str, run: str) -> None:
    """Empties a run that is about to be written again, so that readers never see its
    new citations with its old topics."""
    if exists(spark, f"{store}/topics/run={run}"):
        topics_write(spark.createDataFrame([], TOPICS_SCHEMA), store, run)


def citations_write(citations: DataFrame, store: str, run: str) -> None:
    """Rows stay in order of topic id as they are made, so that the statistics of
    the row groups let readers skip other topics."""
    write_run(citations, f"{store}/citations", run, CITATIONS_SCHEMA)


def topics_load(spark: SparkSession, store: str) -> DataFrame:
    return read_runs(spark, f"{store}/topics", TOPICS_SCHEMA)


def citations_load(spark: SparkSession, store: str) -> DataFrame:
    """Citations of finished runs. The list of finished ones is made from the runs' names
    and joined, whatever their number."""
    finished = topics_load(spark, store).select("run").distinct()
    return read_runs(spark, f"{store}/citations", CITATIONS_SCHEMA).join(broadcast_small(finished), "run", "left_semi")


def append_topics(spark: SparkSession, store: str, new_topics: DataFrame, run: str) -> DataFrame:
    """Adds rows as one more run and returns the whole table."""
    topics_write(new_topics, store, run)
    return topics_load(spark, store)


def store_counts(topics: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: ``n_topics, n_citations``."""
    n_topics = topics.agg(F.count("*").alias("n"))
    n_citations = citations.agg(F.count("*").alias("n"))
    return n_topics.select(F.col("n").alias("n_topics"), n_citations.scalar().alias("n_citations"))


def highest_id(table: DataFrame, column: str) -> int:
    """Zero for none. For stores from before ``sources.register``, which is asked otherwise."""
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
