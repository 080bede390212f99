"""Scores that were paid for once: a stored table by the content of the text pair.

A key is 128 bits of the premise's length and both texts. The table grows by runs; a run
that is repeated replaces its own part. Scores that failed are not stored, so they are tried
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.stores import read_runs, write_run

SCORES_SCHEMA = "pair binary, contra double, entail double"


def pair_key(premise: Column, hypothesis: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(premise).cast("string"), F.lit(":"), premise, hypothesis)))


def scores_load(spark: SparkSession, store: str, but_run: str | None = None) -> DataFrame:
    """``pair, contra, entail``, one row per pair."""
    scores = read_runs(spark, f"{store}/scores", SCORES_SCHEMA)
    others = scores if but_run is None else scores.where(F.col("run") != but_run)
    # Runs at the same time may have scored the same pair.
    return others.groupBy("pair").agg(F.min(F.struct("contra", "entail")).alias("s")).select("pair", "s.contra", "s.entail")


def scores_write(scored: DataFrame, store: str, run: str) -> None:
    write_run(scored, f"{store}/scores", run, SCORES_SCHEMA)
