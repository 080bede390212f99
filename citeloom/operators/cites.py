"""From articles to citations with their sentence.

All of it is row-local: paragraphs and cites are exploded inside the task that
holds the article, so no step here moves data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.html import cited_uris, html_paragraphs, inner_text
from citeloom.functions.markup import markup_paragraphs
from citeloom.functions.sentences import (
    marked_text,
    paragraph_without_uri,
    piece_opening,
    sentence_from_parts,
    text_before,
)


def explode_paragraphs(articles: DataFrame, html_col: str, from_markup: bool) -> DataFrame:
    """One row per paragraph: ``para_no`` (from 0) and ``html``."""
    source = F.col(html_col)
    paragraphs = markup_paragraphs(source) if from_markup else html_paragraphs(source)
    kept = [c for c in articles.columns if c != html_col]
    return articles.select(*kept, F.posexplode(paragraphs).alias("para_no", "html"))


def explode_cites(paragraphs: DataFrame) -> DataFrame:
    """One row per cite with an absolute URI inside a paragraph: ``cite_no``,
    ``uri`` and the paragraph's plain text. Cites outside paragraphs never appear."""
    kept = [c for c in paragraphs.columns if c != "html"]
    # The plain text is made below the explode, once per paragraph that has a cite.
    cited = paragraphs.where(F.rlike("html", F.lit("(?i)<cite")))
    plain = cited.withColumn("paragraph", inner_text(F.col("html")))
    return plain.select(*kept, "paragraph", F.posexplode(cited_uris(F.col("html"))).alias("cite_no", "uri"))


def sentence_found(cites: DataFrame) -> DataFrame:
    """Cites whose sentence can be located: the paragraph's text holds the URI."""
    return cites.where(F.contains("paragraph", F.col("uri")))


def locate_sentences(cites: DataFrame) -> DataFrame:
    """Adds ``sentence`` (null when not found); ``paragraph`` loses the URI."""
    paragraph, uri = F.col("paragraph"), F.col("uri")
    kept = [c for c in cites.columns if c not in ("paragraph", "uri")]
    # One column per intermediate text: each is used several times, computed once.
    parts = (
        cites.withColumn("_marked", marked_text(paragraph, uri))
        .withColumn("_before", text_before(F.col("_marked")))
        .withColumn("_opening", piece_opening(F.col("_before")))
    )
    return parts.select(
        *kept,
        "uri",
        sentence_from_parts(F.col("_marked"), F.col("_before"), F.col("_opening")).alias("sentence"),
        paragraph_without_uri(paragraph, uri).alias("paragraph"),
    )


def extract_citations(articles: DataFrame, html_col: str = "html", from_markup: bool = True) -> DataFrame:
    """Articles to citations: keeps the other columns of ``articles`` and adds
    ``para_no, cite_no, uri, sentence, paragraph``."""
    paragraphs = explode_paragraphs(articles, html_col, from_markup)
    return locate_sentences(sentence_found(explode_cites(paragraphs)))


def has_cites(html: Column, from_markup: bool = True) -> Column:
    """Does any paragraph hold a cite with an absolute URI?"""
    paragraphs = markup_paragraphs(html) if from_markup else html_paragraphs(html)
    return F.exists(paragraphs, lambda p: F.size(cited_uris(p)) > 0)


def cited_articles(articles: DataFrame, html_col: str = "html", from_markup: bool = True) -> DataFrame:
    """Articles with at least one citation. Works on the row: no join is needed."""
    return articles.where(has_cites(F.col(html_col), from_markup))
