"""Row filters of the ingest job and the report of what they dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.markup import is_redirect, ref_rewrite, ref_strip

# Titles with these beginnings are not articles.
SKIPPED_PREFIXES = (
    "Category:",
    "Template:",
    "Talk:",
    "Help:",
    "Special:",
    "Wikipedia:",
    "MediaWiki:",
    "Module:",
    "Portal:",
    "Draft:",
    "List of ",
)


def is_article_title(title: Column) -> Column:
    return ~F.rlike(title, F.lit("^(?:" + "|".join(SKIPPED_PREFIXES) + ")"))


def skip_present(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles whose title is not a stored topic name (exact, case-sensitive)."""
    stored = topics.select(F.col("name").alias("title"))
    return articles.join(stored, "title", "left_anti")


def namespace_filter(articles: DataFrame) -> DataFrame:
    return articles.where(is_article_title(F.col("title")))


def redirect_filter(articles: DataFrame) -> DataFrame:
    return articles.where(~is_redirect(F.col("markup")))


def clean_markup(articles: DataFrame) -> DataFrame:
    """References rewritten and left-over reference tags removed."""
    return articles.withColumn("markup", ref_strip(ref_rewrite(F.col("markup"))))


def empty_filter(articles: DataFrame) -> DataFrame:
    """Articles with anything but white space left."""
    return articles.where(F.rlike("markup", F.lit(r"\S")))


def first_per_title(articles: DataFrame) -> DataFrame:
    """One row per title, the lowest article id; all columns of that row.

    A partial aggregate, so many copies of one title shrink before the shuffle.
    """
    rest = [c for c in articles.columns if c != "title"]
    order = ["article_id"] + [c for c in rest if c != "article_id"]
    first = F.min(F.struct(*order)).alias("_first")
    return articles.groupBy("title").agg(first).select("title", *[F.col(f"_first.{c}").alias(c) for c in rest])


def ingest_outcomes(articles: DataFrame) -> DataFrame:
    """Articles per outcome, from a row set with a ``reason`` column."""
    return articles.groupBy("reason").agg(F.count("*").alias("n"))


def outcome_reason(present: Column, title: Column, markup: Column, clean: Column, n_cites: Column, embedded: Column) -> Column:
    """First reason that stops an article, in the order the job checks them."""
    return (
        F.when(present, "present")
        .when(~is_article_title(title), "namespace")
        .when(markup.isNull(), "missing page")
        .when(is_redirect(markup), "redirect")
        .when(~F.rlike(clean, F.lit(r"\S")), "empty")
        .when(n_cites == 0, "no cites")
        .when(~embedded, "embedding failed")
        .otherwise("stored")
    )
