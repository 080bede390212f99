"""Cases worked out by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from citeloom.functions.html import cite_extract, html_paragraphs
from citeloom.functions.markup import is_redirect, markup_paragraphs, markup_to_html, ref_rewrite, ref_strip, template_to_cite
from citeloom.functions.sentences import citation_sentence, paragraph_without_uri
from citeloom.functions.text import claim_clean, topic_text_clean, whitespace_collapse
from citeloom.functions.uris import absolute_uri
from citeloom.functions.vectors import has_unit_norm, score_parse, score_shape_ok, softmax2, vector_parse
from citeloom.operators.cites import extract_citations
from citeloom.operators.filters import is_article_title
from citeloom.sources.citation_files import file_name
from citeloom.sources.dump import block_table, index_parse
from citeloom.sources.packed import pack_manifest, packed_ranges


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


U = "http://u/1"


@pytest.mark.parametrize(
    "paragraph, sentence",
    [
        (f"Alpha one. Beta two. {U} Gamma three.", "Alpha one. Beta two"),
        (f"Alpha one. Beta {U} two. Gamma.", "Beta   two"),
        (f"{U} Alpha. Beta.", "  Alpha"),
        (f"Alpha one.{U} Beta.", "Alpha one.  Beta"),
        (f"A {U} b. C {U} d.", "A   b"),
        (f"Only. {U}", "Only"),
        (f" {U}", "   "),
        ("nothing cited", None),
        ("a" * 60 + ". " + "b" * 60 + ". " + "c" * 60 + f". {U}", "b" * 60 + ". " + "c" * 60),
        ("a" * 60 + ". " + "b" * 100 + f". {U}", "b" * 100),
        ("a" * 60 + ". " + "b" * 99 + f". {U}", "a" * 60 + ". " + "b" * 99),
        ("a. b. c. " + "d" * 98 + f". {U}", "c. " + "d" * 98),
        ("a. b. c. " + "d" * 97 + f". {U}", "c. " + "d" * 97),
        ("a. b. c. " + "d" * 96 + f". {U}", "b. c. " + "d" * 96),
        ("a.. b. . " + f"{U} x", "a.. b. "),
        ("One.\n Two. " + f"{U}. Three", "One.\n Two.  "),
        (f"One.  {U}. Three", "One"),
    ],
)
def test_citation_sentence(spark, paragraph, sentence):
    assert one(spark, citation_sentence(F.lit(paragraph), F.lit(U))) == sentence


def test_citation_sentence_properties(spark):
    """What the rule promises, whatever the paragraph: a run of whole pieces, the shortest
    that is long enough, with the URI's places blanked."""
    import random

    random.seed(5)
    rows = []
    for _ in range(3000):
        parts = random.choices([". ", ".", " ", U, U + "/2", "word", "w" * 30, "x" * 97, "y" * 100, "\n", ".. "], k=random.randint(1, 14))
        rows.append(("".join(parts),))
    got = spark.createDataFrame(rows, "p string").select("p", citation_sentence(F.col("p"), F.lit(U)).alias("s")).collect()
    assert len(got) == 3000
    for p, s in got:
        # A blank behind the last stop ends a piece as well.
        before, _, after = (p + " ").partition(U)
        if U not in p:
            assert s is None
            continue
        begin = before.rfind(". ") + 2 if ". " in before else 0
        lead, complete = before[begin:], before[: max(begin - 2, 0)]
        if lead.strip() == "" and begin > 0:
            # Nothing but the URI opens the piece: pieces before it, from a piece's start.
            assert complete.endswith(s) and (len(s) == len(complete) or complete[: -len(s) or None].endswith(". ") or s == "")
            inner = s.find(". ")
            assert len(s) >= 100 or len(s) == len(complete)
            assert inner < 0 or len(s) - inner - 2 < 100
        else:
            end = after.partition(". ")[0]
            assert s == lead + " " + end.replace(U, " ")


def test_paragraph_without_uri(spark):
    assert one(spark, paragraph_without_uri(F.lit(f"a {U} b {U}/2"), F.lit(U))) == "a   b  /2"


@pytest.mark.parametrize(
    "markup, expected",
    [
        ("<ref>{{cite web|url=http://a.b/c|title=T}}</ref>", "{{Cite web |url=http://a.b/c}}"),
        ("<ref>[http://d.e f g]</ref>", "{{Cite web |url=http://d.e}}"),
        ("x<ref>plain</ref>y", "x<ref>plain</ref>y"),
        ("<ref>{{cite web|url=http://z.z}}</ref>", "{{Cite web |url=http://z.z}}"),
        ('<REF name="a">no yes:x</REF>', "{{Cite web |url=yes:x}}"),
        ("<ref>archive-url=http://q.q url=http://r.r</ref>", "{{Cite web |url=http://q.q}}"),
        ("a<ref>u http://1.1</ref>b<ref>n</ref>c<ref>http://2.2</ref>", "a{{Cite web |url=http://1.1}}b<ref>n</ref>c{{Cite web |url=http://2.2}}"),
        ("no refs", "no refs"),
        ("", ""),
    ],
)
def test_ref_rewrite(spark, markup, expected):
    assert one(spark, ref_rewrite(F.lit(markup))) == expected


def test_ref_strip(spark):
    assert one(spark, ref_strip(F.lit('x<ref>plain</ref>y<ref name="a" />z<references>'))) == "x plain y z<references>"


@pytest.mark.parametrize(
    "markup, expected",
    [
        ("{{Cite web |url=http://a.b}}", "<cite>http://a.b</cite>"),
        ("{{cite web|title=T|url= http://a.b |x=y}}", "<cite>http://a.b</cite>"),
        ("{{Cite_web|url=one|url=two}}", "<cite>two</cite>"),
        ("{{sfn|Smith|2001|loc=http://s}}", "<cite>http://s</cite>"),
        ("{{Sfnm|a|loc=p. 3}}", "<cite>p. 3</cite>"),
        ("{{sfn|Smith|2001}}", "<cite>{{{loc}}}</cite>"),
        ("{{Cite web}}", "<cite>{{{url}}}</cite>"),
        ("{{cite book|url=x}} {{Infobox|url=x}}", " "),
        ("a {{cite web|url=http://g.h/i|date={{date|1}}}} b", "a <cite>http://g.h/i</cite> b"),
        ("{{Infobox|a={{nowrap|{{lang|x}}}}|ref={{cite web|url=http://in.box}}}}Text", "Text"),
        ("a {{open and {{sfn|loc=x}} b", "a {{open and {{sfn|loc=x}} b"),
        ("a }} b {{stub}}", "a }} b "),
    ],
)
def test_template_to_cite(spark, markup, expected):
    assert one(spark, template_to_cite(F.lit(markup))) == expected


def test_templates_against_counting(spark):
    """Braces in any order, against counting them one by one."""
    import random
    import re

    random.seed(1)
    tokens = ["{{", "}}", "{", "}", "{{{", "}}}", "{{sfn|loc=x", "|loc=y", "a", "\n"]
    rows = ["".join(random.choices(tokens, k=random.randint(0, 22))) for _ in range(3000)]

    def by_counting(text):
        open_at, depth, spans = 0, 0, []
        for mark in re.finditer(r"\{\{|\}\}", text):
            if mark.group() == "{{":
                open_at = open_at if depth else mark.start()
                depth += 1
            elif depth:
                depth -= 1
                spans += [] if depth else [(open_at, mark.end())]
        return spans

    got = spark.createDataFrame([(r,) for r in rows], "m string").select("m", template_to_cite(F.col("m")).alias("html")).collect()
    assert len(got) == 3000
    for text, html in got:
        parts, last = [], 0
        for begin, end in by_counting(text):
            parts.append(re.escape(text[last:begin]) + r"(?:<cite>[^<]*</cite>)?")
            last = end
        assert re.fullmatch("".join(parts) + re.escape(text[last:]), html), (text, html)


def test_templates_take_time_by_length(spark):
    import time

    unit = "text {{cite web|title=T {{lang|x}}|url=http://a.b/c}} and {{nowrap|b}} "

    def seconds(copies):
        text = spark.range(1).select(F.repeat(F.lit(unit), F.lit(copies)).alias("m")).cache()
        text.count()
        work = text.select(F.length(template_to_cite(F.col("m"))))
        work.collect()
        begun = time.perf_counter()
        work.collect()
        return time.perf_counter() - begun

    assert seconds(40_000) < 10 * max(seconds(10_000), 0.2)


@pytest.mark.parametrize(
    "markup, expected",
    [
        (
            "'''Bob''' of [[town|city]] and [[Rome]].<ref>{{cite web|url=http://g.h|x=y}}</ref>",
            "Bob of city and Rome.<cite>http://g.h</cite>",
        ),
        ("a<!-- <ref>{{cite web|url=http://no}}</ref> -->b<!-- open", "ab"),
        ("[[File:x.png|thumb|of [[Bob|him]] here]]c [http://x.y label]", "c label"),
    ],
)
def test_markup_to_html(spark, markup, expected):
    assert one(spark, markup_to_html(F.lit(markup))) == expected


def test_markup_paragraphs(spark):
    text = "First\nline.\n\n== Head ==\nAfter head.\n* item {{c}}\n{| table\n|-\n\n   \nLast."
    assert one(spark, markup_paragraphs(F.lit(text))) == ["First\nline.", "After head.", "Last."]


def test_html(spark):
    page = '<style>p{a}</style><p>one<p class="x">two <cite>http://u/1</cite></p>out<cite>http://u/2</cite><P>three</P>'
    assert one(spark, html_paragraphs(F.lit(page))) == ["one", "two <cite>http://u/1</cite>", "three"]
    assert one(spark, cite_extract(F.lit("<cite><i>a</i>b</cite><cite class='q'>c</cite>"))) == ["ab", "c"]
    rows = spark.createDataFrame([(1, page)], "id int, html string")
    assert [r["uri"] for r in extract_citations(rows, from_markup=False).collect()] == ["http://u/1"]
    outside = spark.createDataFrame([(1, "<div><cite>http://u/1</cite></div>")], "id int, html string")
    assert extract_citations(outside, from_markup=False).count() == 0


def test_absolute_uri(spark):
    for text, expected in [("Smith 2001, p. 3", False), ("https://a.b", True), ("urn:x", True), ("1a:x", False), ("a: b", False)]:
        assert one(spark, absolute_uri(F.lit(text))) is expected


def test_topic_text(spark):
    html = 'See <a href="/w" title="X (page does not exist)">X</a> and <b>bold</b> {{{loc}}} https://example.com/a'
    assert one(spark, whitespace_collapse(topic_text_clean(F.lit(html)))) == "See and bold xample.com/a"
    assert one(spark, whitespace_collapse(topic_text_clean(F.lit(html), full_urls=True))) == "See and bold"
    assert one(spark, whitespace_collapse(F.lit(" a  b\r\n\tc "))) == "a b c"


def test_claim_clean(spark):
    assert one(spark, claim_clean(F.lit("A: b https://x.y/z\nc"))) == "A  b   c"
    assert one(spark, claim_clean(F.lit("  a\r\nb\t"))) == "a b"


def test_filters(spark):
    for title, kept in [("Help:A", False), ("List of B", False), ("File:C", True), ("help:D", True), ("Draft:", False)]:
        assert one(spark, is_article_title(F.lit(title))) is kept
    for markup, redirect in [("#REDIRECT [[Q]]", True), ("#redirect [[Q]]", False), ("#REDIRECT[[Q]]", False)]:
        assert one(spark, is_redirect(F.lit(markup))) is redirect


def test_blocks(spark):
    lines = spark.createDataFrame([("d", v) for v in ("100:1:A", "100:2:Help: x", "200:3:C:d:e")] + [("e", "50:4:F")], "dump_path string, value string")
    index = index_parse(lines)
    assert [r["title"] for r in index.orderBy("article_id").collect()] == ["A", "Help: x", "C:d:e", "F"]
    lengths = spark.createDataFrame([("d", 900), ("e", 70)], "dump_path string, data_len bigint")
    rows = block_table(index, lengths).orderBy("dump_path", "block_start").collect()
    assert [tuple(r) for r in rows] == [("d", 100, 200, 2), ("d", 200, 900, 1), ("e", 50, 70, 1)]


def test_packing(spark):
    files = spark.createDataFrame(
        [(f"/c/000000{n}.xml.bz2", size) for n, size in ((4, 7), (1, 10), (2, 5))] + [("/c/x.xml.bz2", 3)], "path string, length bigint"
    )
    lines = pack_manifest(files)
    assert sorted(r["line"] for r in lines.collect()) == ["1:0", "2:10", "4:15"]
    ranges = {r["file_number"]: (r["start_offset"], r["length"]) for r in packed_ranges(lines, 22).collect()}
    assert ranges == {1: (0, 10), 2: (10, 5), 4: (15, 7)}
    assert one(spark, file_name(F.lit(12))) == "0000012.xml.bz2"
    assert one(spark, file_name(F.lit(123456789))) == "123456789.xml.bz2"


def test_scores(spark):
    soft = one(spark, softmax2(F.lit(-1.0), F.lit(2.0)))
    assert (round(soft["contra"], 4), round(soft["entail"], 4)) == (0.0474, 0.9526)
    big = one(spark, softmax2(F.lit(-1000.0), F.lit(1000.0)))
    assert (big["contra"], big["entail"]) == (0.0, 1.0)
    assert tuple(one(spark, score_parse(F.lit("[0.25 0.75]")))) == (0.25, 0.75)
    for bad in ("[ 0.1 0.9]", "[0.1]", "[a b]"):
        assert one(spark, score_parse(F.lit(bad))) is None
    assert one(spark, score_shape_ok(F.lit(None).cast("string"))) is False
    assert one(spark, vector_parse(F.lit("[0.1 -2e-3\r\n 3.]"))) == [0.1, -0.002, 3.0]
    assert one(spark, vector_parse(F.lit("[0.1 x]"))) is None
    for norm, ok in ((1.005, True), (1.02, False)):
        assert one(spark, has_unit_norm(F.array(F.lit(norm / math.sqrt(2)), F.lit(norm / math.sqrt(2))))) is ok


def test_tag_patterns_are_equivalent():
    """The patterns in use are linear; they match what the rule's own patterns match."""
    import random
    import re

    from citeloom.functions.markup import REF_TAG
    from citeloom.functions.text import ANY_TAG

    random.seed(2)
    for told, used, letters in (
        (r"<\s*.+?/?\s*(\s+[^>]*?)?>", ANY_TAG, "<> /\na"),
        (r"(?i)<\s*/?\s*ref(\s+[^>]*?)?>", REF_TAG, ["<", ">", " ", "/", "\n", "ref", "Ref", "s"]),
    ):
        told, used = re.compile(told), re.compile(used)
        for _ in range(50_000):
            text = "".join(random.choices(letters, k=random.randint(1, 10)))
            assert told.sub("_", text) == used.sub("_", text), text
