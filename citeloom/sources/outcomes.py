"""What became of the articles of a run that were not stored, and why.

One row per article and run, in ``outcomes/run=<id>`` beside the stored tables. The next run
reads it: what a place in a dump is known to hold does not change, so redirects, empty pages
and pages without cites are not read again from there. Missing pages and failed embeddings
are tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.stores import read_runs, topics_load, write_run

OUTCOMES_SCHEMA = "dump_path string, block_start bigint, article_id bigint, title string, reason string, detail string"

#: Reasons that lie in the page itself.
LASTING = ("redirect", "empty", "no cites")

STORED = "stored"


def outcomes_write(outcomes: DataFrame, store: str, run: str) -> None:
    write_run(outcomes, f"{store}/outcomes", run, OUTCOMES_SCHEMA)


def outcomes_load(spark: SparkSession, store: str) -> DataFrame:
    return read_runs(spark, f"{store}/outcomes", OUTCOMES_SCHEMA)


def lasting_outcomes(spark: SparkSession, store: str, run: str) -> DataFrame:
    """``dump_path, block_start, article_id``: pages that other runs found to be of no use."""
    found = outcomes_load(spark, store).where(F.col("reason").isin(*LASTING) & (F.col("run") != run))
    return found.where("dump_path is not null").select("dump_path", "block_start", "article_id").distinct()


def run_report(spark: SparkSession, store: str, run: str) -> DataFrame:
    """``reason, n`` of a run, with what it stored."""
    dropped = outcomes_load(spark, store).where(F.col("run") == run).groupBy("reason").agg(F.count("*").alias("n"))
    kept = topics_load(spark, store).where(F.col("run") == run).agg(F.count("*").alias("n")).where("n > 0")
    return dropped.unionByName(kept.select(F.lit(STORED).alias("reason"), "n"))
