"""Checks of the stored tables; each returns the violations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique_name(topics: DataFrame) -> DataFrame:
    return topics.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def check_citation_fk(citations: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic ids that citations name and the topics table lacks, with their number of
    citations. Counting first keeps a popular topic from skewing the join."""
    counts = citations.groupBy("topic_id").agg(F.count("*").alias("n"))
    return counts.join(topics.select("topic_id"), "topic_id", "left_anti")


def check_types(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column, the number of rows whose text is missing or not of the type."""
    bad = [F.count_if(F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()]
    counts = raw.agg(*bad)
    return counts.unpivot([], list(types), "column_name", "n_bad")
