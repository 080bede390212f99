"""Wiki markup: inline references, citation templates, paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.uris import absolute_uri

# Inline reference with a plain body; any left-over reference tag.
INLINE_REF = r"(?i)<ref[^>]*+>[^<]*+</ref>"
REF_TAG = r"(?i)<\s*/?\s*ref(?:\s[^>]*)?>"

# Citation templates and the argument that becomes the <cite> text.
CITE_TEMPLATES = {r"[Ss]fnm?": "loc", r"[Cc]ite[ _]+web": "url"}

# A line that opens a heading, list item, table or preformatted
# block is never part of a paragraph; blank lines separate paragraphs.
BLOCK_LINE = r"(?md)^(?:[=*#:;|! ]|\{\|).*$"
PARAGRAPH_BREAK = r"\n\s*\n"

# Fixed value: upper case and the trailing blank are needed.
REDIRECT_MARK = "#REDIRECT "


def _first_url(body: Column) -> Column:
    """URL named in a reference body, or null.

    ``url=`` wins and runs to the next blank; without it the first blank-separated
    word that is an absolute URI is taken. Closing braces are never part of it.
    """
    plain = F.translate(body, "|[]", " ")
    named = F.split_part(F.substr(plain, F.instr(plain, "url=") + 4), F.lit(" "), F.lit(1))
    words = F.filter(F.split(plain, " "), absolute_uri)
    url = F.when(F.contains(plain, F.lit("url=")), named).otherwise(F.get(words, F.lit(0)))
    return F.substring_index(url, "}}", 1)


def ref_rewrite(markup: Column) -> Column:
    """Inline references that name a URL become ``{{Cite web |url=...}}``.

    Spark has no replace-with-function: the text is cut at the references, each
    reference is rewritten, and both lists are joined again.
    """
    between = F.split(markup, INLINE_REF, -1)
    refs = F.regexp_extract_all(markup, F.lit(INLINE_REF), F.lit(0))

    def rewrite(ref: Column) -> Column:
        body = F.left(F.substr(ref, F.instr(ref, ">") + 1), F.length(ref) - F.instr(ref, ">") - len("</ref>"))
        return F.coalesce(F.concat(F.lit("{{Cite web |url="), _first_url(body), F.lit("}}")), ref)

    rejoined = F.array_join(
        F.zip_with(between, refs, lambda text, ref: F.concat(text, F.coalesce(rewrite(ref), F.lit("")))), ""
    )
    # Many texts hold no reference; skip the list work for them.
    return F.when(F.rlike(markup, F.lit(INLINE_REF)), rejoined).otherwise(markup)


def ref_strip(markup: Column) -> Column:
    """Left-over reference tags become a blank; their body stays."""
    return F.regexp_replace(markup, REF_TAG, " ")


def _cite_of(template: Column) -> Column:
    """``<cite>argument</cite>`` for the inside of a citation template, nothing for any
    other. The last copy of a repeated argument counts, a missing one leaves its
    ``{{{name}}}`` placeholder."""
    cite = F.lit("")
    for name, argument in CITE_TEMPLATES.items():
        head = r"(?s)^\s*" + name + r"\s*"
        valued = head + r"\|(?:.*\|)?\s*" + argument + r"\s*=\s*([^|]*?)\s*(?:\|.*)?$"
        cite = (
            F.when(F.rlike(template, F.lit(valued)), F.concat(F.lit("<cite>"), F.regexp_extract(template, valued, 1), F.lit("</cite>")))
            .when(F.rlike(template, F.lit(head + r"(?:\|.*)?$")), F.lit("<cite>{{{" + argument + "}}}</cite>"))
            .otherwise(cite)
        )
    return cite


# A template without braces inside; the opening of one that has some, or is never closed.
FLAT_TEMPLATE = r"\{\{([^{}]*+)\}\}"
NESTED = r"\{\{[^{}]*+(?!\}\})"


def _flat_templates(markup: Column) -> Column:
    """For texts in which no template holds a brace: each is one match, all else is text."""
    between = F.split(markup, FLAT_TEMPLATE, -1)
    insides = F.regexp_extract_all(markup, F.lit(FLAT_TEMPLATE), F.lit(1))
    return F.array_join(F.zip_with(between, insides, lambda text, inside: F.concat(text, F.when(inside.isNotNull(), _cite_of(inside)).otherwise(""))), "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. A lambda that names an expression itself
    would work it out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _brace_levels(marks: Column) -> Column:
    """``struct<i, opens, level>`` per brace token, in order: ``level`` is opened minus closed
    up to and with the token, below zero where more were closed.

    A running sum without a fold: the k-th opening token, i-th of all, has i - k closing ones
    before it, and the other way round. Each kind is counted by its place in its own list.
    """

    def kind(mark: str) -> Column:
        return F.filter(F.transform(marks, lambda m, i: F.when(m == mark, i)), lambda i: i.isNotNull())

    opening = F.transform(kind("{{"), lambda i, k: F.struct(i.alias("i"), F.lit(True).alias("opens"), (2 * k + 1 - i).alias("level")))
    closing = F.transform(kind("}}"), lambda i, k: F.struct(i.alias("i"), F.lit(False).alias("opens"), (i - 2 * k - 1).alias("level")))
    return F.array_sort(F.concat(opening, closing))


def _strays(levels: Column) -> Column:
    """Places of closing tokens that close nothing: the first to reach each level below zero.
    The m-th of them is the first at level -m, as levels go in steps of one."""
    low = F.filter(levels, lambda t: ~t.opens & (t.level < 0))
    by_level = F.array_sort(F.transform(low, lambda t: F.struct((-t.level).alias("m"), t.i.alias("i"))))
    firsts = _bound(by_level, lambda low: F.filter(low, lambda t, at: (at == 0) | (F.get(low, at - 1).m != t.m)))
    return F.transform(firsts, lambda t: t.i)


def _at_top(level: Column, i: Column, strays: Column) -> Column:
    """Whether nothing is open at a level between two tokens, seen from token ``i``: as many
    strays as the level is below zero lie before it."""
    before = F.get(strays, -level - 1) < i
    after = F.get(strays, -level) > i
    return (level <= 0) & F.coalesce(before, level == 0) & F.coalesce(after, F.lit(True))


def _without_templates(pieces: Column, marks: Column, levels: Column, strays: Column) -> Column:
    """``pieces`` lie between the ``marks``: piece j before mark j."""
    gaps = F.transform(
        pieces,
        lambda piece, j: F.struct(
            piece.alias("text"), F.coalesce(F.get(marks, j - 1), F.lit("")).alias("mark"), F.coalesce(F.get(levels, j - 1).level, F.lit(0)).alias("level")
        ),
    )
    opening = F.filter(levels, lambda t: t.opens & _at_top(t.level - 1, t.i, strays))
    closing = F.filter(levels, lambda t: ~t.opens & _at_top(t.level, t.i, strays))

    def raw(gaps: Column, first: Column, length: Column) -> Column:
        """Text of pieces with the marks between them."""
        texts = F.transform(F.slice(gaps, first + 1, length), lambda g, at: F.when(at == 0, g.text).otherwise(F.concat(g.mark, g.text)))
        return F.array_join(texts, "")

    def cut(now: Column) -> Column:
        """Templates in order: the text since the one before, then what comes of the template."""

        def step(end: Column, t: Column) -> Column:
            begin = F.get(now.opening, t)
            since = F.when(t == 0, 0).otherwise(F.get(now.closing, t - 1).i + 1)
            nested = F.slice(now.gaps, begin.i + 2, end.i - begin.i)
            inside = F.array_join(F.transform(F.filter(nested, lambda g: g.level == begin.level), lambda g: g.text), "")
            return F.concat(raw(now.gaps, since, begin.i - since + 1), _bound(inside, _cite_of))

        last = F.coalesce(F.get(now.closing, F.size(now.closing) - 1).i + 1, F.lit(0))
        return F.concat(F.array_join(F.transform(now.closing, step), ""), raw(now.gaps, last, F.size(now.gaps) - last))

    return _bound(F.struct(gaps.alias("gaps"), opening.alias("opening"), closing.alias("closing")), cut)


def template_to_cite(markup: Column) -> Column:
    """Citation templates become ``<cite>argument</cite>``, all other templates go.

    Braces are counted, so that a template may stand inside another one: only the outermost
    counts, and what is nested in its arguments goes. Braces that are never closed are
    text, and so are those that were never opened.

    The text is cut at its braces once, levels are counted over the list of braces, and the
    slices that stay are joined once: work grows with the text, but for a sort of braces.
    """
    brace = r"\{\{|\}\}"

    def levelled(cut: Column) -> Column:
        return _bound(_brace_levels(cut.marks), lambda levels: _bound(_strays(levels), lambda strays: _without_templates(cut.pieces, cut.marks, levels, strays)))

    def by_kind(text: Column) -> Column:
        found = F.struct(F.split(text, brace, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(brace), F.lit(0)).alias("marks"))
        # Many texts hold no template, most others none inside another: less work for both.
        return F.when(F.rlike(text, F.lit(NESTED)), _bound(found, levelled)).when(F.contains(text, F.lit("{{")), _flat_templates(text)).otherwise(text)

    return _bound(markup, by_kind)


def drop_comments(markup: Column) -> Column:
    """Without ``<!-- ... -->``; one that is never closed runs to the end."""
    return F.regexp_replace(markup, r"(?s)<!--.*?(?:-->|\z)", "")


def plain_links(markup: Column) -> Column:
    """Links become their label, files, images and categories go, and so do the quotes
    that make text bold."""
    media = r"(?i)\[\[\s*(?:File|Image|Category)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*+\]\]"
    linked = F.regexp_replace(F.regexp_replace(markup, media, ""), r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(linked, r"\[https?://[^\s\[\]]+ ([^\[\]]*)\]", "$1"), "'{2,}", "")


def markup_to_html(markup: Column) -> Column:
    """A page's markup as paragraphs of text with ``<cite>`` elements: comments first, as
    what they hold is not part of the page, then references, templates, links."""
    return plain_links(template_to_cite(ref_strip(ref_rewrite(drop_comments(markup)))))


def markup_paragraphs(markup: Column) -> Column:
    """Paragraphs of a markup text as ``array<string>``, blank ones dropped."""
    without_blocks = F.regexp_replace(markup, BLOCK_LINE, "\n")
    return F.filter(F.split(without_blocks, PARAGRAPH_BREAK, -1), lambda p: F.rlike(p, F.lit(r"\S")))


def is_redirect(markup: Column) -> Column:
    return F.startswith(markup, F.lit(REDIRECT_MARK))
