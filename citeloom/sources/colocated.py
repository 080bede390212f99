"""Topics and citations laid out for their join: both in buckets of the topic id.

A join on the topic id then moves the other side alone, which is slim; no citation text is
shuffled. Buckets are read by one task each, so topics that are too large a share of a
bucket are kept beside them, in plain files, and joined by their output instead; so are
topics that too many matches ask for.

The tables are written from a store now and then; they are read like any other table, and
newer runs can be joined from the store itself.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.skew import HOT_ROWS, salted_join
from citeloom.session import broadcast_small, plan_bytes, stage
from citeloom.sources.numbered import create_text, exists, read_text

#: Estimated bytes of a bucket.
BUCKET_BYTES = 256 << 20

CITED = "topic_id bigint, citation_id bigint, uri string, sentence string"
NAMED = "topic_id bigint, name string"


@dataclass
class Colocated:
    """``topics`` (``topic_id, name``) and ``citations`` in buckets; ``large``: citations of
    topics with more than ``large_rows``; ``counts``: ``topic_id, n`` of both."""

    topics: DataFrame
    citations: DataFrame
    large: DataFrame
    counts: DataFrame
    large_rows: int


def _table(spark: SparkSession, path: str, name: str, schema: str, buckets: int) -> DataFrame:
    """The folder as a bucketed table of the session's catalog, which knows it by its path."""
    known = f"colocated_{name}_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {known} ({schema}) USING parquet "
        f"CLUSTERED BY (topic_id) SORTED BY (topic_id) INTO {buckets} BUCKETS LOCATION '{path}/{name}'"
    )
    return spark.table(known)


def write_colocated(topics: DataFrame, citations: DataFrame, path: str, buckets: int | None = None, large_rows: int | None = None) -> None:
    """Writes the tables below a new ``path``. A topic with more than ``large_rows`` citations
    (a quarter of an even bucket, unless given) is kept out of the buckets."""
    spark = citations.sparkSession
    cited = citations.select("topic_id", "citation_id", "uri", "sentence")
    counts = stage(cited.groupBy("topic_id").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan_bytes(cited) / BUCKET_BYTES))
    large_rows = large_rows if large_rows is not None else max(HOT_ROWS, total // buckets // 4)
    # Unless given otherwise there are at most four large topics per bucket, by arithmetic.
    large = broadcast_small(counts.where(F.col("n") > large_rows).select("topic_id"))
    cited.join(large, "topic_id", "left_semi").write.parquet(f"{path}/large")
    counts.write.parquet(f"{path}/counts")
    usual = cited.join(large, "topic_id", "left_anti")
    for name, rows in (("citations", usual), ("topics", topics.select("topic_id", "name"))):
        scratch_name = f"{name}_{hashlib.md5(path.encode()).hexdigest()}_draft"
        # One file per bucket.
        spread = rows.repartition(buckets, "topic_id").write.bucketBy(buckets, "topic_id").sortBy("topic_id")
        spread.option("path", f"{path}/{name}").format("parquet").saveAsTable(scratch_name)
        # Only the session's name for it goes: the folder is the caller's.
        spark.sql(f"DROP TABLE {scratch_name}")
    create_text(spark, f"{path}/layout", json.dumps({"buckets": buckets, "large_rows": large_rows}))


def read_colocated(spark: SparkSession, path: str) -> Colocated:
    if not exists(spark, f"{path}/layout"):
        raise ValueError(f"{path} holds no finished layout")
    layout = json.loads(read_text(spark, f"{path}/layout"))
    buckets = layout["buckets"]
    return Colocated(
        _table(spark, path, "topics", NAMED, buckets),
        _table(spark, path, "citations", CITED, buckets),
        spark.read.schema(CITED).parquet(f"{path}/large"),
        spark.read.schema("topic_id bigint, n bigint").parquet(f"{path}/counts"),
        layout["large_rows"],
    )


def colocated_citations(matches: DataFrame, tables: Colocated, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``operators.support.topic_citations``, without moving the citations' texts.

    ``matches`` should be a staged table. Topics that make more than a quarter of a fair
    partition's output are joined apart, spread by their output; so are the large ones.
    """
    spark = matches.sparkSession
    asked = matches.groupBy("topic_id").agg(F.count("*").alias("_asked")).join(tables.counts, "topic_id")
    asked = stage(asked.withColumn("_rows", F.col("_asked").cast("double") * F.col("n")), "asked")
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = (asked.agg(F.sum("_rows")).first()[0] or 0) / slots
    # Few: by arithmetic at most four per partition, and the large topics.
    apart_rows = asked.where((F.col("_rows") > max(fair, hot_rows)) | (F.col("n") > tables.large_rows))
    apart_ids = [r.topic_id for r in apart_rows.select("topic_id").collect()]
    named = matches.join(tables.topics, "topic_id")
    apart = F.col("topic_id").isin(apart_ids)
    usual = tables.citations.where(~apart).join(named.where(~apart), "topic_id")
    spread = tables.citations.where(apart).unionByName(tables.large.where(apart))
    hot = salted_join(spread, stage(named.where(apart), "hot"), ["topic_id"], ["citation_id"], ["claim_id"], plain_bytes=0, hot_rows=hot_rows)
    columns = ["claim_id", "topic_id", "sim", "rank", "name", "citation_id", "uri", "sentence"]
    return usual.select(columns).unionByName(hot.select(columns))
