"""Inputs the given tables do not hold, derived from all of their rows.

Each has a Spark form and the same thing as a SQL common table expression. A residue
of an id picks the *shape* of a row here; it never drops a row.
"""

from __future__ import annotations

import bz2
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.filters import SKIPPED_PREFIXES
from citeloom.session import scratch_path
from citeloom.sources.dump import dump_lengths, locate

# --- index lines over pages -------------------------------------------------

DATA_LEN = 10**12


def page_index_lines(pages: DataFrame) -> DataFrame:
    """A hundred pages per block; page URLs hold colons, as titles may."""
    start = F.floor(F.col("page_id") / 100) * 1000 + 600
    return pages.select(
        F.lit("dump").alias("dump_path"), F.concat_ws(":", start, F.col("page_id"), F.col("url")).alias("value")
    )


PAGE_INDEX_SQL = """page_index AS (
  SELECT (page_id // 100) * 1000 + 600 AS block_start, page_id AS article_id, url AS title FROM pages
)"""


def page_lengths(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame([("dump", DATA_LEN)], "dump_path string, data_len bigint")


# --- titles -----------------------------------------------------------------

TITLE_BEGINNINGS = [*SKIPPED_PREFIXES, "File:", "help:", ""]


def titled(ident: Column, name: Column) -> Column:
    beginnings = F.array(*[F.lit(p) for p in TITLE_BEGINNINGS])
    return F.concat(F.get(beginnings, F.pmod(ident, F.lit(len(TITLE_BEGINNINGS))).cast("int")), name)


def titled_sql(ident: str, name: str) -> str:
    values = ", ".join(f"'{p}'" for p in TITLE_BEGINNINGS)
    return f"([{values}])[{ident} % {len(TITLE_BEGINNINGS)} + 1] || {name}"


ARTICLE_TITLE_SQL = "([" + ", ".join(f"'{p}'" for p in SKIPPED_PREFIXES) + "])"


# --- markup over documents --------------------------------------------------
# Every line of a document becomes a paragraph; six shapes take turns: trailing
# reference, reference inside, leading reference, no URL, sfn template, one URL twice.


def cite_uri(doc_id: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit("https://ex.org"), doc_id, number)


def document_markup(documents: DataFrame) -> DataFrame:
    """``article_id, title, markup`` for all documents, whole texts."""

    def paragraph(line: Column, number: Column) -> Column:
        uri = cite_uri(F.col("doc_id"), number)
        shape = F.pmod(F.col("doc_id") + number, F.lit(6))
        stop = F.instr(line, ". ")
        inside = F.concat(F.lit(" <ref>["), uri, F.lit(" name]</ref>"))
        return (
            F.when(shape == 0, F.concat(line, F.lit(" <ref>{{cite web|url="), uri, F.lit("|title=T}}</ref> More text")))
            .when((shape == 1) & (stop == 0), F.concat(line, inside))
            .when(shape == 1, F.concat(F.substr(line, F.lit(1), stop - 1), inside, F.substr(line, stop)))
            .when(shape == 2, F.concat(F.lit('<ref name="a">{{cite web|url='), uri, F.lit("}}</ref> "), line))
            .when(shape == 3, F.concat(line, F.lit('<ref>plain note</ref> and <ref name="a" />')))
            .when(shape == 4, F.concat(line, F.lit(" {{sfn|Smith|2001|loc="), uri, F.lit("}}")))
            .otherwise(
                F.concat(line, F.lit(" {{cite web|url="), uri, F.lit("}} "), line, F.lit(" {{Cite_web|title=x|url="), uri, F.lit(" }}."))
            )
        )

    lines = F.split("text", "\n", -1)
    return documents.select(
        F.col("doc_id").alias("article_id"),
        F.concat_ws(":", "source", "doc_id").alias("title"),
        F.array_join(F.transform(lines, paragraph), "\n\n").alias("markup"),
    )


def noisy_markup(documents: DataFrame) -> DataFrame:
    """``document_markup`` with what is not part of a page's text: nested templates around,
    a comment with a reference, bold quotes, links. What a page says is the same."""
    box = "{{Infobox place\n| name = {{nowrap|{{lang|x|Box}}}}\n| url = https://box.org/1\n}}"
    hidden = "<!-- no <ref>{{cite web|url=https://hidden.org/1}}</ref>\n -->"
    nested = F.replace("markup", F.lit("|title=T}}</ref>"), F.lit("|title={{lang|de|{{nowrap|T}}}}}}</ref>"))
    linked = F.regexp_replace(nested, r"(?m)^(\p{L}+) ", "[[Some place (town)|$1]] ")
    noisy = F.concat(F.lit(box + hidden + "[[File:a.png|thumb|see [[b]]]]"), linked, F.lit("'''" + "{{stub}}"))
    return document_markup(documents).withColumn("markup", F.when(F.pmod("article_id", F.lit(3)) == 0, noisy).otherwise(F.col("markup")))


def _shapes_sql(shapes: list[str], other: str) -> str:
    cases = " ".join(f"WHEN {n} THEN {s}" for n, s in enumerate(shapes))
    return f"CASE (doc_id + line_no) % 6 {cases} ELSE {other} END"


_INSIDE = "CASE WHEN strpos(line, '. ') = 0 THEN line || {x} ELSE line[1:strpos(line, '. ') - 1] || {x} || line[strpos(line, '. '):] END"

# One row per line of a document: line_no from 0, line, uri, shape.
LINES_SQL = """lines AS (
  SELECT doc_id, n - 1 AS line_no, string_split(text, chr(10))[n] AS line,
         'https://ex.org/' || doc_id || '/' || (n - 1) AS uri, (doc_id + n - 1) % 6 AS shape
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
)"""

RAW_PARAGRAPH = _shapes_sql(
    [
        "line || ' <ref>{{cite web|url=' || uri || '|title=T}}</ref> More text'",
        _INSIDE.format(x="' <ref>[' || uri || ' name]</ref>'"),
        "'<ref name=\"a\">{{cite web|url=' || uri || '}}</ref> ' || line",
        "line || '<ref>plain note</ref> and <ref name=\"a\" />'",
        "line || ' {{sfn|Smith|2001|loc=' || uri || '}}'",
    ],
    "line || ' {{cite web|url=' || uri || '}} ' || line || ' {{Cite_web|title=x|url=' || uri || ' }}.'",
)

# The same paragraphs after the steps of the job, said directly.
REWRITTEN_PARAGRAPH = _shapes_sql(
    [
        "line || ' {{Cite web |url=' || uri || '}} More text'",
        _INSIDE.format(x="' {{Cite web |url=' || uri || '}}'"),
        "'{{Cite web |url=' || uri || '}} ' || line",
        "line || '<ref>plain note</ref> and <ref name=\"a\" />'",
        "line || ' {{sfn|Smith|2001|loc=' || uri || '}}'",
    ],
    "line || ' {{cite web|url=' || uri || '}} ' || line || ' {{Cite_web|title=x|url=' || uri || ' }}.'",
)

HTML_PARAGRAPH = _shapes_sql(
    [
        "line || ' <cite>' || uri || '</cite> More text'",
        _INSIDE.format(x="' <cite>' || uri || '</cite>'"),
        "'<cite>' || uri || '</cite> ' || line",
        "line || ' plain note  and  '",
        "line || ' <cite>' || uri || '</cite>'",
    ],
    "line || ' <cite>' || uri || '</cite> ' || line || ' <cite>' || uri || '</cite>.'",
)


def joined_sql(paragraph: str, alias: str) -> str:
    """Paragraphs of a document put together again, per ``doc_id``."""
    return f"SELECT doc_id, string_agg({paragraph}, chr(10) || chr(10) ORDER BY line_no) AS {alias} FROM lines GROUP BY doc_id"


# Paragraphs that survive: not blank, not opened by a block character.
PARAGRAPHS_SQL = f"""{LINES_SQL}, html_lines AS (
  SELECT doc_id, line_no, uri, shape, {HTML_PARAGRAPH} AS html FROM lines
), paragraphs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS para_no
  FROM html_lines WHERE html <> '' AND NOT regexp_matches(html, '^[=*#:;|! ]')
)"""

# One row per cite; the last shape holds its URI twice. Marker: U+E000.
CITES_SQL = f"""{PARAGRAPHS_SQL}, raw_cites AS (
  SELECT doc_id, para_no, uri, regexp_replace(html, '<[^>]*>', '', 'g') AS paragraph,
         unnest(CASE shape WHEN 5 THEN [0, 1] WHEN 3 THEN []::INTEGER[] ELSE [0] END) AS cite_no
  FROM paragraphs
), pieces AS (
  SELECT *, string_split(replace(paragraph, uri, chr(57344)) || ' ', '. ') AS p FROM raw_cites
), marked AS (
  SELECT *, list_position(list_transform(p, lambda x: contains(x, chr(57344))), true) AS i FROM pieces
), cites AS (
  SELECT doc_id, para_no, cite_no, uri, replace(paragraph, uri, ' ') AS paragraph,
         replace(CASE WHEN starts_with(trim(p[i]), chr(57344)) AND i > 1
                      THEN list_reduce(list_reverse(p[1:i - 1]),
                             lambda a, x: CASE WHEN length(a) < 100 THEN x || '. ' || a ELSE a END)
                      ELSE p[i] END, chr(57344), ' ') AS sentence
  FROM marked
)"""

# Topic text of each document: the whole HTML through the four passes, then one blank
# per run of white space.
TOPIC_TEXT_SQL = f"""{LINES_SQL}, html AS ({joined_sql(HTML_PARAGRAPH, "html")}), topic_text AS (
  SELECT doc_id, trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<a[^>]+?title="[^"]*?page\\sdoes\\snot\\sexist[^"]*?">[^<]+?</a>', ' ', 'gi'),
      '<\\s*.+?/?\\s*(\\s+[^>]*?)?>', ' ', 'gi'),
      '\\{{\\{{\\{{[^}}]+?\\}}\\}}\\}}', ' ', 'gi'),
      'https?://[^\\s]+?', ' ', 'gi'), '\\s+', ' ', 'g')) AS text
  FROM html
)"""


def embedding_sql(source: str, key: str, text: str) -> str:
    """CTEs ``{source}_parts`` (key, bucket, value) by the rule of the stand-in encoder."""
    return f"""{source}_words AS (
  SELECT {key}, unnest(string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' ')) AS word FROM {source}
), {source}_sums AS (
  SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket,
         sum(CASE WHEN ('0x' || substr(md5(word), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS s
  FROM {source}_words WHERE word <> '' GROUP BY 1, 2
), {source}_parts AS (
  SELECT {key}, bucket, CAST(s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS FLOAT) AS value
  FROM {source}_sums WHERE s <> 0
)"""


# --- dump files over documents ----------------------------------------------


def page_xml(articles: DataFrame) -> Column:
    def escaped(text: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(entity))
        return text

    return F.concat(
        F.lit("<page><title>"),
        escaped(F.col("title")),
        F.lit("</title><ns>0</ns><id>"),
        F.col("article_id").cast("string"),
        F.lit('</id><revision><id>7</id><text bytes="1" xml:space="preserve">'),
        escaped(F.col("markup")),
        F.lit("</text></revision></page>"),
    )


def write_plain_dump(articles: DataFrame) -> str:
    """Dump without blocks: bz2 text, one page after the other."""
    path = scratch_path(articles.sparkSession, "dump")
    articles.select(page_xml(articles).alias("value")).write.option("compression", "bzip2").text(path)
    return path


#: Characters of documents for one file of a stream, a few megabytes of bz2.
FILE_CHARS = 16_000_000


def write_dump_files(documents: DataFrame, articles: DataFrame, batches: int, file_chars: int = FILE_CHARS) -> tuple[str, int]:
    """The dump as files for a stream of ``batches`` micro-batches, and the files of a batch: one
    while the documents are few, more of about the same size when they are many, so that no
    task writes a share of the whole."""
    chars = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    files = max(1, -(-chars // (batches * file_chars)))
    return write_plain_dump(articles.repartition(batches * files)), files


def write_block_dump(articles: DataFrame, pages_per_block: int = 100) -> tuple[DataFrame, DataFrame]:
    """Multi-member dump files, one per task, with their index and lengths.

    Only for tests and checks: tasks write their file straight to the shared folder, by the
    file system that its path names.
    """
    spark = articles.sparkSession
    folder = scratch_path(spark, "blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, inner = locate(folder)
        filesystem.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.xml.bz2"
        path = f"{re.sub('^file:/+', '/', folder)}/{name}"
        lines: list[str] = []
        pending: list[str] = []
        with filesystem.open_output_stream(f"{inner}/{name}", compression=None) as file:

            def flush() -> None:
                if pending:
                    file.write(bz2.compress("\n".join(pending).encode()))
                    pending.clear()

            for batch in batches:
                for row in batch.to_pylist():
                    if len(pending) == pages_per_block:
                        flush()
                    lines.append(f"{file.tell()}:{row['article_id']}:{row['title']}")
                    pending.append(row["xml"])
            flush()
        yield pa.RecordBatch.from_pydict({"dump_path": [path] * len(lines), "value": pa.array(lines, pa.string())})

    rows = articles.select("article_id", "title", page_xml(articles).alias("xml"))
    index_path = scratch_path(spark, "index")
    rows.mapInArrow(write, "dump_path string, value string").write.parquet(index_path)
    return spark.read.parquet(index_path), dump_lengths(spark, folder)
