"""HTML: paragraphs, cites, inner text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.uris import absolute_uri

# Fixed values.
P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
P_CLOSE = r"(?i)</p\s*>"
CITE = r"(?is)<cite(?:\s[^>]*)?>(.*?)</cite\s*>"
TAG = r"<[^>]*>"


def inner_text(html: Column) -> Column:
    """Tags removed, entities left as they are."""
    return F.regexp_replace(html, TAG, "")


def html_paragraphs(html: Column) -> Column:
    """Bodies of the ``<p>`` elements as ``array<string>``; an unclosed one ends
    where the next starts."""
    pieces = F.split(html, P_OPEN, -1)
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda piece: F.get(F.split(piece, P_CLOSE, 2), F.lit(0)),
    )


def cite_extract(html: Column) -> Column:
    """Texts of all ``<cite>`` elements as ``array<string>``."""
    return F.transform(F.regexp_extract_all(html, F.lit(CITE), F.lit(1)), inner_text)


def cited_uris(html: Column) -> Column:
    """Cite texts that are absolute URIs."""
    return F.filter(cite_extract(html), absolute_uri)
