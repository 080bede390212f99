"""Which sentence of a paragraph does a citation support?

The cited URI is swapped for a one-character marker and the paragraph is cut at
``". "``. The piece with the first marker decides: if the marker opens the piece, the
citation trails the text before it, and that text is taken from its end (look-behind);
otherwise the piece itself is the sentence.

Only the pieces next to the first marker matter, so they are found with string search
from the marker. That needs no array of pieces and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MARK = "\ue000"
SENTENCE_END = ". "
LOOK_BEHIND_CHARS = 100


def paragraph_without_uri(paragraph: Column, uri: Column) -> Column:
    """Every copy of the URI becomes a blank."""
    return F.replace(paragraph, uri, F.lit(" "))


def marked_text(paragraph: Column, uri: Column) -> Column:
    """Paragraph with the URI swapped for the marker."""
    return F.concat(F.replace(paragraph, uri, F.lit(MARK)), F.lit(" "))


def sentence_lookbehind(text: Column) -> Column:
    """Last sentence of ``text``; earlier ones are added in front while the result is
    shorter than ``LOOK_BEHIND_CHARS``.

    That is the shortest tail on a sentence start that is long enough: the last
    ``LOOK_BEHIND_CHARS`` characters, and what lies before them back to a sentence end.
    """
    head = F.left(text, F.greatest(F.length(text) - LOOK_BEHIND_CHARS, F.lit(0)))
    return F.concat(F.substring_index(head, SENTENCE_END, -1), F.right(text, F.lit(LOOK_BEHIND_CHARS)))


def text_before(marked: Column) -> Column:
    """Text before the first marker."""
    return F.substring_index(marked, MARK, 1)


def piece_opening(before: Column) -> Column:
    """Part of the marked piece that lies before the marker."""
    return F.substring_index(before, SENTENCE_END, -1)


def sentence_from_parts(marked: Column, before: Column, opening: Column) -> Column:
    """Sentence for the first marker in ``marked``; null when there is none."""
    closing = F.substring_index(F.substr(marked, F.length(before) + 2), SENTENCE_END, 1)
    earlier = F.left(before, F.length(before) - F.length(opening) - len(SENTENCE_END))
    trailing = ~F.rlike(opening, F.lit(r"(?U)\S")) & (F.length(before) > F.length(opening))
    piece = F.concat(opening, F.lit(" "), F.replace(closing, F.lit(MARK), F.lit(" ")))
    return F.when(
        F.contains(marked, F.lit(MARK)), F.when(trailing, sentence_lookbehind(earlier)).otherwise(piece)
    )


def citation_sentence(paragraph: Column, uri: Column) -> Column:
    """Sentence that holds the citation; null when it was not found."""
    marked = marked_text(paragraph, uri)
    before = text_before(marked)
    return sentence_from_parts(marked, before, piece_opening(before))
