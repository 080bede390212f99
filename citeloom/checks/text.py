"""Checked queries: text functions and citation extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks.inputs import (
    CITES_SQL,
    HTML_PARAGRAPH,
    LINES_SQL,
    PARAGRAPHS_SQL,
    RAW_PARAGRAPH,
    REWRITTEN_PARAGRAPH,
    document_markup,
    noisy_markup,
    joined_sql,
)
from citeloom.checks.registry import Tables, query
from citeloom.functions.html import cite_extract, html_paragraphs, inner_text
from citeloom.functions.markup import markup_to_html, ref_rewrite, ref_strip, template_to_cite
from citeloom.functions.sentences import sentence_lookbehind
from citeloom.functions.text import claim_clean, prompt_build, topic_text_clean, whitespace_collapse
from citeloom.functions.uris import absolute_uri
from citeloom.operators.cites import (
    cited_articles,
    explode_cites,
    explode_paragraphs,
    extract_citations,
    locate_sentences,
    sentence_found,
)
from citeloom.operators.support import split_claims


def article_html(t: Tables):
    return noisy_markup(t.documents).select("article_id", "title", markup_to_html(F.col("markup")).alias("html"))


# --- markup -----------------------------------------------------------------


@query("ref_rewrite", f"WITH {LINES_SQL}, m AS ({joined_sql(REWRITTEN_PARAGRAPH, 'x')}) SELECT doc_id AS article_id, md5(x) AS markup_md5, length(x) AS n_chars FROM m")
def _(t):
    new = ref_rewrite(F.col("markup"))
    return document_markup(t.documents).select("article_id", F.md5(new).alias("markup_md5"), F.length(new).cast("bigint").alias("n_chars"))


@query(
    "ref_strip",
    f"""WITH {LINES_SQL}, m AS ({joined_sql(RAW_PARAGRAPH, 'x')}),
s AS (SELECT doc_id, regexp_replace(x, '<\\s*/?\\s*ref(\\s+[^>]*?)?>', ' ', 'gi') AS x FROM m)
SELECT doc_id AS article_id, md5(x) AS markup_md5, length(x) AS n_chars FROM s""",
)
def _(t):
    new = ref_strip(F.col("markup"))
    return document_markup(t.documents).select("article_id", F.md5(new).alias("markup_md5"), F.length(new).cast("bigint").alias("n_chars"))


MARKUP_HTML_SQL = f"WITH {LINES_SQL}, m AS ({joined_sql(HTML_PARAGRAPH, 'x')}) SELECT doc_id AS article_id, md5(x) AS html_md5, length(x) AS n_chars FROM m"


@query("template_to_cite", MARKUP_HTML_SQL)
def _(t):
    html = template_to_cite(ref_strip(ref_rewrite(F.col("markup"))))
    return document_markup(t.documents).select("article_id", F.md5(html).alias("html_md5"), F.length(html).cast("bigint").alias("n_chars"))


@query("markup_to_html", MARKUP_HTML_SQL)
def _(t):
    """Pages with comments, links and nested templates give the same HTML as those without."""
    return article_html(t).select("article_id", F.md5("html").alias("html_md5"), F.length("html").cast("bigint").alias("n_chars"))


@query("markup_paragraphs", f"WITH {PARAGRAPHS_SQL} SELECT doc_id AS article_id, para_no, md5(html) AS html_md5 FROM paragraphs")
def _(t):
    rows = explode_paragraphs(article_html(t).drop("title"), "html", from_markup=True)
    return rows.select("article_id", F.col("para_no").cast("bigint").alias("para_no"), F.md5("html").alias("html_md5"))


# --- cites ------------------------------------------------------------------


@query(
    "cite_extract",
    f"WITH {LINES_SQL} SELECT doc_id AS article_id, uri, (CASE shape WHEN 5 THEN 2 ELSE 1 END)::BIGINT AS n FROM lines WHERE shape <> 3",
)
def _(t):
    uris = article_html(t).select("article_id", F.explode(cite_extract(F.col("html"))).alias("uri"))
    return uris.groupBy("article_id", "uri").agg(F.count("*").alias("n"))


@query("in_paragraph", f"WITH {CITES_SQL} SELECT doc_id AS article_id, para_no, cite_no, uri FROM raw_cites")
def _(t):
    cites = explode_cites(explode_paragraphs(article_html(t), "html", from_markup=True))
    return cites.select("article_id", F.col("para_no").cast("bigint").alias("para_no"), "cite_no", "uri")


@query("paragraph_without_uri", f"WITH {CITES_SQL} SELECT doc_id AS article_id, para_no, cite_no, md5(paragraph) AS paragraph_md5 FROM cites")
def _(t):
    cites = extract_citations(article_html(t))
    return cites.select("article_id", F.col("para_no").cast("bigint").alias("para_no"), "cite_no", F.md5("paragraph").alias("paragraph_md5"))


@query("citation_sentence", f"WITH {CITES_SQL} SELECT doc_id AS article_id, para_no, cite_no, uri, sentence FROM cites")
def _(t):
    cites = extract_citations(article_html(t))
    return cites.select("article_id", F.col("para_no").cast("bigint").alias("para_no"), "cite_no", "uri", "sentence")


@query(
    "sentence_lookbehind",
    """WITH p AS (
  SELECT doc_id, string_split(replace(text, chr(10), ' '), '. ') AS l FROM documents
), w AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)
SELECT doc_id, i - 1 AS piece_no,
  CASE WHEN i = 1 THEN l[1] ELSE list_reduce(list_reverse(l[1:i]),
    lambda a, x: CASE WHEN length(a) < 100 THEN x || '. ' || a ELSE a END) END AS sentence
FROM w""",
)
def _(t):
    pieces = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ", -1)
    rows = t.documents.select("doc_id", pieces.alias("l")).select("doc_id", "l", F.posexplode("l").alias("i", "_"))
    so_far = F.array_join(F.slice("l", F.lit(1), F.col("i") + 1), ". ")
    return rows.select("doc_id", F.col("i").cast("bigint").alias("piece_no"), sentence_lookbehind(so_far).alias("sentence"))


@query(
    "sentence_found",
    f"""WITH {PARAGRAPHS_SQL}, tried AS (
  SELECT doc_id, para_no, contains(html, 'https://ex.org/' || doc_id || '/0') AS found FROM paragraphs
) SELECT doc_id AS article_id, para_no FROM tried WHERE found""",
)
def _(t):
    # Look for the first line's URI in every paragraph: most do not hold it.
    paragraphs = explode_paragraphs(article_html(t), "html", from_markup=True)
    first = F.concat(F.lit("https://ex.org/"), F.col("article_id"), F.lit("/0"))
    tried = paragraphs.select("article_id", "para_no", inner_text(F.col("html")).alias("paragraph"), first.alias("uri"))
    return locate_sentences(sentence_found(tried)).where("sentence is not null").select("article_id", F.col("para_no").cast("bigint").alias("para_no"))


@query("cited_articles", f"WITH {CITES_SQL} SELECT DISTINCT doc_id AS article_id FROM cites")
def _(t):
    return cited_articles(article_html(t)).select("article_id")


@query(
    "absolute_uri",
    """WITH w AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ')) AS word FROM documents
), made AS (
  SELECT word FROM w UNION ALL SELECT 'https://' || word FROM w UNION ALL SELECT word || ': x' FROM w UNION ALL SELECT url FROM pages
) SELECT word, count(*) AS n FROM made WHERE regexp_matches(word, '^[A-Za-z][A-Za-z0-9+.-]*:\\S') GROUP BY word""",
)
def _(t):
    words = t.documents.select(F.explode(F.split(F.regexp_replace("text", r"\s", " "), " ")).alias("word"))
    made = words.select(F.explode(F.array("word", F.concat(F.lit("https://"), "word"), F.concat("word", F.lit(": x")))).alias("word"))
    return made.union(t.pages.select("url")).where(absolute_uri(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


# --- HTML -------------------------------------------------------------------

HTML_PARAGRAPHS_SQL = """p AS (
  SELECT page_id, regexp_split_to_array(html, '(?i)<p(?:\\s[^>]*)?>')[2:] AS bodies FROM pages
), b AS (
  SELECT page_id, unnest(range(1, len(bodies) + 1)) AS n, bodies FROM p
), paras AS (SELECT page_id, n - 1 AS para_no, regexp_split_to_array(bodies[n], '(?i)</p\\s*>')[1] AS html FROM b)"""


@query("html_paragraphs", f"WITH {HTML_PARAGRAPHS_SQL} SELECT page_id, para_no, html FROM paras")
def _(t):
    rows = t.pages.select("page_id", F.posexplode(html_paragraphs(F.col("html"))).alias("para_no", "html"))
    return rows.withColumn("para_no", F.col("para_no").cast("bigint"))


@query("inner_text", f"WITH {HTML_PARAGRAPHS_SQL} SELECT page_id, para_no, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM paras")
def _(t):
    rows = t.pages.select("page_id", F.posexplode(html_paragraphs(F.col("html"))).alias("para_no", "html"))
    return rows.select("page_id", F.col("para_no").cast("bigint").alias("para_no"), inner_text(F.col("html")).alias("text"))


@query(
    "topic_text_clean",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html || ' {{{loc}}} <a href="/w" title="X (page does not exist)">X</a> ' || url || ' ' || html,
  '<a[^>]+?title="[^"]*?page\\sdoes\\snot\\sexist[^"]*?">[^<]+?</a>', ' ', 'gi'),
  '<\\s*.+?/?\\s*(\\s+[^>]*?)?>', ' ', 'gi'), '\\{\\{\\{[^}]+?\\}\\}\\}', ' ', 'gi'),
  'https?://[^\\s]+?', ' ', 'gi') AS text FROM pages""",
)
def _(t):
    html = F.concat("html", F.lit(' {{{loc}}} <a href="/w" title="X (page does not exist)">X</a> '), "url", F.lit(" "), "html")
    return t.pages.select("page_id", topic_text_clean(html).alias("text"))


@query("whitespace_collapse", "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t.pages.select("page_id", whitespace_collapse(F.col("html")).alias("text"))


# --- claims -----------------------------------------------------------------

CLAIM_CLEAN_SQL = "trim(replace(regexp_replace(regexp_replace({x}, '\\r?\\n', ' ', 'g'), 'https?://[^\\s]+', ' ', 'g'), ':', ' '))"


@query("claim_clean", "SELECT conv_id, turn, " + CLAIM_CLEAN_SQL.format(x="' ' || role || ': https://x.y/' || turn || ' ' || text || ' '") + " AS text FROM conversations")
def _(t):
    said = F.concat(F.lit(" "), "role", F.lit(": https://x.y/"), "turn", F.lit(" "), "text", F.lit(" "))
    return t.conversations.select("conv_id", "turn", claim_clean(said).alias("text"))


@query("claim_lines", "SELECT conv_id * 100 + turn AS claim_id, 0 AS line_no, " + CLAIM_CLEAN_SQL.format(x="text") + " AS hypothesis FROM conversations")
def _(t):
    return split_claims(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), "text"))


@query("prompt_build", "SELECT conv_id, turn, 'premise: ' || text || ' hypothesis: ' || role AS prompt FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", prompt_build(F.col("text"), F.col("role")).alias("prompt"))
