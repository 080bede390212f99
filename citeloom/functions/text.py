"""Plain-text clean-up: topic text, claim text, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The passes applied to page HTML before it is embedded. Each match
# becomes one blank. (?i) ignores case, (?d) lets "." stop at \n only.
MISSING_PAGE_LINK = r'(?id)<a[^>]+?title="[^"]*?page\sdoes\snot\sexist[^"]*?">[^<]+?</a>'
ANY_TAG = r"<\s*[^\n][^>]*>"
DIRECTIVE = r"(?id)\{\{\{[^}]+?\}\}\}"
URL_START = r"(?id)https?://[^\s]+?"
FULL_URL = r"(?id)https?://[^\s]+"

# Fixed value: a whole URL in a claim or premise (case matters here).
CLAIM_URL = r"(?U)https?://[^\s]+"


def topic_text_clean(html: Column, full_urls: bool = False) -> Column:
    """Text of a page as given to the encoder.

    By default the URL pass drops the scheme and one more character, which is what
    stored vectors were made from; ``full_urls=True`` drops the whole URL.
    """
    text = html
    for pattern in (MISSING_PAGE_LINK, ANY_TAG, DIRECTIVE, FULL_URL if full_urls else URL_START):
        text = F.regexp_replace(text, pattern, " ")
    return text


def whitespace_collapse(text: Column) -> Column:
    """Every run of (Unicode) white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_all(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def claim_clean(text: Column) -> Column:
    """Line breaks, whole URLs and colons become blanks; ends are trimmed."""
    one_line = F.regexp_replace(text, r"\r?\n", " ")
    no_urls = F.regexp_replace(one_line, CLAIM_URL, " ")
    return trim_all(F.replace(no_urls, F.lit(":"), F.lit(" ")))


def claim_lines(text: Column) -> Column:
    """Lines of a claim that are judged one by one: the whole text is one line."""
    return F.array(text)


def prompt_build(premise: Column, hypothesis: Column) -> Column:
    """Prompt text of the entailment model."""
    return F.concat(F.lit("premise: "), premise, F.lit(" hypothesis: "), hypothesis)
