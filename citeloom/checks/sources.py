"""Checked queries: index, dump, citation files, packing, stored tables, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks.inputs import (
    ARTICLE_TITLE_SQL,
    CITES_SQL,
    DATA_LEN,
    PAGE_INDEX_SQL,
    document_markup,
    page_index_lines,
    page_lengths,
    titled,
    titled_sql,
    write_block_dump,
    write_plain_dump,
)
from citeloom.checks.registry import query
from citeloom.functions.markup import template_to_cite
from citeloom.operators.cites import extract_citations
from citeloom.operators.filters import (
    clean_markup,
    empty_filter,
    namespace_filter,
    redirect_filter,
    skip_present,
)
from citeloom.operators.ordered import assign_ids, with_next, with_running_total
from citeloom.operators.quality import check_citation_fk, check_types, check_unique_name
from citeloom.operators.support import citation_text_join, distinct_files, id_semi_filter
from citeloom.session import scratch_path
from citeloom.sources.blocks import read_blocks, write_block_index
from citeloom.sources.citation_files import (
    citation_xml_read,
    citation_xml_write,
    file_manifest,
    file_name,
    list_files,
)
from citeloom.sources.dump import (
    articles_per_block,
    block_table,
    dump_read,
    dump_read_blocks,
    index_join_pages,
    index_misses,
    index_parse,
)
from citeloom.sources.packed import (
    numeric_name_filter,
    pack_compact,
    pack_manifest,
    pack_offsets,
    packed_ranges,
)
from citeloom.sources.stores import (
    append_topics,
    citations_load,
    citations_write,
    store_counts,
    topics_load,
    topics_write,
)

# --- index and blocks -------------------------------------------------------


def page_index(t):
    return index_parse(page_index_lines(t.pages))


BLOCKS_SQL = f"""{PAGE_INDEX_SQL}, blocks AS (
  SELECT block_start, lead(block_start, 1, {DATA_LEN}) OVER (ORDER BY block_start) AS block_end, n_articles
  FROM (SELECT block_start, count(*) AS n_articles FROM page_index GROUP BY block_start)
)"""


@query("index_parse", f"WITH {PAGE_INDEX_SQL} SELECT * FROM page_index")
def _(t):
    return page_index(t).drop("dump_path")


@query("block_table", f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def _(t):
    return block_table(page_index(t), page_lengths(t.pages)).drop("dump_path")


@query("block_end", f"WITH {BLOCKS_SQL} SELECT block_start, block_end FROM blocks")
def _(t):
    return block_table(page_index(t), page_lengths(t.pages)).select("block_start", "block_end")


@query("block_end_many", f"WITH {BLOCKS_SQL} SELECT block_start, block_end FROM blocks")
def _(t):
    """Ends, offsets and ids the way of large tables, whatever their size: by ranges."""
    starts = page_index(t).select("block_start").distinct()
    ended = with_next(starts, ["block_start"], "block_start", "block_end", small_bytes=0)
    return ended.select("block_start", F.coalesce("block_end", F.lit(DATA_LEN)).alias("block_end"))


@query("articles_per_block", f"WITH {BLOCKS_SQL} SELECT block_start, block_end, article_id, title FROM blocks JOIN page_index USING (block_start)")
def _(t):
    index = page_index(t)
    lists = articles_per_block(index, block_table(index, page_lengths(t.pages)), per_chunk=40)
    return lists.select("block_start", "block_end", F.explode("articles").alias("a")).select("block_start", "block_end", "a.article_id", "a.title")


# --- filters ----------------------------------------------------------------


@query("skip_present", "SELECT page_id AS article_id, url AS title FROM pages WHERE url NOT LIKE 'https:%'")
def _(t):
    articles = t.pages.select(F.col("page_id").alias("article_id"), F.col("url").alias("title"))
    stored = t.pages.where(F.startswith("url", F.lit("https:"))).select(F.col("url").alias("name"))
    return skip_present(articles, stored).select("article_id", "title")


@query(
    "namespace_filter",
    f"WITH a AS (SELECT page_id AS article_id, {titled_sql('page_id', 'url')} AS title FROM pages) "
    f"SELECT * FROM a WHERE NOT list_bool_or(list_transform({ARTICLE_TITLE_SQL}, lambda p: starts_with(title, p)))",
)
def _(t):
    return namespace_filter(t.pages.select(F.col("page_id").alias("article_id"), titled(F.col("page_id"), F.col("url")).alias("title")))


REDIRECTS_SQL = "CASE source WHEN 'src1' THEN '#REDIRECT [[' || text WHEN 'src2' THEN '#redirect [[' || text WHEN 'src3' THEN '#REDIRECT[[' || text ELSE text END"


def with_redirects(t):
    markup = (
        F.when(F.col("source") == "src1", F.concat(F.lit("#REDIRECT [["), "text"))
        .when(F.col("source") == "src2", F.concat(F.lit("#redirect [["), "text"))
        .when(F.col("source") == "src3", F.concat(F.lit("#REDIRECT[["), "text"))
        .otherwise(F.col("text"))
    )
    return t.documents.select(F.col("doc_id").alias("article_id"), markup.alias("markup"))


@query("redirect_filter", f"SELECT doc_id AS article_id, md5({REDIRECTS_SQL}) AS markup_md5 FROM documents WHERE NOT starts_with({REDIRECTS_SQL}, '#REDIRECT ')")
def _(t):
    return redirect_filter(with_redirects(t)).select("article_id", F.md5("markup").alias("markup_md5"))


@query("empty_filter", "SELECT doc_id AS article_id FROM documents WHERE lang <> 'de' AND trim(replace(text, chr(10), ' ')) <> ''")
def _(t):
    markup = F.when(F.col("lang") == "de", F.lit('<ref name="a" />\n<ref name="b" />')).otherwise(F.col("text"))
    return empty_filter(clean_markup(t.documents.select(F.col("doc_id").alias("article_id"), markup.alias("markup")))).select("article_id")


# --- dump -------------------------------------------------------------------


@query(
    "index_join_pages",
    """SELECT d.doc_id AS article_id, l.doc_id IS NOT NULL AS found, CASE WHEN l.doc_id IS NOT NULL THEN md5(text) END AS markup_md5
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def _(t):
    # The dump lacks the pages of documents without a label.
    index = document_markup(t.documents).select("article_id", "title")
    labelled = t.labels.select("doc_id").distinct()
    pages = t.documents.join(labelled, "doc_id").select(F.col("doc_id").alias("article_id"), F.col("text").alias("markup"))
    hits = index_join_pages(index, pages).select("article_id", F.lit(True).alias("found"), F.md5("markup").alias("markup_md5"))
    misses = index_misses(index, pages).select("article_id", F.lit(False).alias("found"), F.lit(None).cast("string").alias("markup_md5"))
    return hits.unionByName(misses)


def plain_articles(t):
    return t.documents.select(F.col("doc_id").alias("article_id"), F.concat_ws(":", "source", "doc_id").alias("title"), F.col("text").alias("markup"))


PLAIN_SQL = "SELECT doc_id AS article_id, source || ':' || doc_id AS title, md5(text) AS markup_md5 FROM documents"


@query("dump_read", PLAIN_SQL)
def _(t):
    return dump_read(t.spark, write_plain_dump(plain_articles(t))).select("article_id", "title", F.md5("markup").alias("markup_md5"))


@query("dump_read_blocks", PLAIN_SQL)
def _(t):
    lines, lengths = write_block_dump(plain_articles(t))
    index = index_parse(lines)
    pages = dump_read_blocks(articles_per_block(index, block_table(index, lengths)))
    return pages.select("article_id", "title", F.md5("markup").alias("markup_md5"))


@query("dump_blocks_source", PLAIN_SQL)
def _(t):
    lines, lengths = write_block_dump(plain_articles(t))
    where = scratch_path(t.spark, "block-index")
    write_block_index(index_parse(lines), lengths, where)
    return read_blocks(t.spark, where).select("article_id", "title", F.md5("markup").alias("markup_md5"))


# --- citation files: fifty documents per file, the whole text as the sentence


def document_citations(t):
    return t.documents.select(
        F.col("doc_id").alias("citation_id"),
        F.col("doc_id").alias("topic_id"),
        F.floor(F.col("doc_id") / 50).alias("file_number"),
        F.concat(F.lit("https://ex.org/?a=1&b="), F.col("doc_id")).alias("uri"),
        F.col("text").alias("sentence"),
        F.col("lang").alias("paragraph"),
    )


DOCUMENT_CITATIONS_SQL = """citations AS (
  SELECT doc_id AS citation_id, doc_id AS topic_id, doc_id // 50 AS file_number, 'https://ex.org/?a=1&b=' || doc_id AS uri, text AS sentence, lang AS paragraph FROM documents
)"""


def written_files(t) -> str:
    path = scratch_path(t.spark, "files")
    citation_xml_write(document_citations(t), path)
    return path


@query("citation_xml_write", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT DISTINCT lpad(file_number::VARCHAR, 7, '0') AS file FROM citations")
def _(t):
    files = list_files(t.spark, written_files(t))
    return files.select(F.regexp_extract("path", r"/file=(\d+)/[^/]*\.xml\.bz2$", 1).alias("file")).distinct()


@query("citation_xml_read", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT file_number, citation_id, uri, md5(sentence) AS sentence_md5 FROM citations")
def _(t):
    return citation_xml_read(t.spark, written_files(t)).select("file_number", "citation_id", "uri", F.md5("sentence").alias("sentence_md5"))


# Sizes of made-up files, named by number, and files with other names.
FILES_SQL = """files AS (
  SELECT '/c/' || lpad((doc_id // 50)::VARCHAR, 7, '0') || '.xml.bz2' AS path, sum(n_chars)::BIGINT AS length FROM documents GROUP BY doc_id // 50
  UNION ALL SELECT '/c/' || source || '.xml.bz2', count(*) FROM documents GROUP BY source
  UNION ALL SELECT '/c/1.txt', count(*) FROM documents
), numbered AS (
  SELECT *, (string_split(path[4:], '.')[1])::BIGINT AS file_number FROM files WHERE regexp_matches(path, '^/c/\\d+\\.xml\\.bz2$')
), offsets AS (
  SELECT *, coalesce(sum(length) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM numbered
)"""


def files_of(t):
    def named(name, length, *keys):
        return t.documents.groupBy(*keys).agg(length.alias("length")).select(F.concat(F.lit("/c/"), name).alias("path"), "length")

    number = F.floor(F.col("doc_id") / 50).alias("number")
    numbered = named(file_name(F.col("number")), F.sum("n_chars"), number)
    other = named(F.concat("source", F.lit(".xml.bz2")), F.count("*"), "source")
    return numbered.union(other).union(named(F.lit("1.txt"), F.count("*")))


@query("file_manifest", f"WITH {FILES_SQL} SELECT max(file_number) AS last_file_number, sum(length)::BIGINT AS total_bytes FROM numbered")
def _(t):
    return file_manifest(files_of(t))


@query("numeric_name_filter", f"WITH {FILES_SQL} SELECT path, length, file_number FROM numbered")
def _(t):
    return numeric_name_filter(files_of(t))


@query("pack_offset", f"WITH {FILES_SQL} SELECT file_number, length, start_offset FROM offsets")
def _(t):
    return pack_offsets(files_of(t)).select("file_number", "length", "start_offset")


@query("pack_offset_many", f"WITH {FILES_SQL} SELECT file_number, length, start_offset FROM offsets")
def _(t):
    numbered = with_running_total(numeric_name_filter(files_of(t)), ["path"], "length", "start_offset", small_bytes=0)
    return numbered.select("file_number", "length", "start_offset")


@query("pack_manifest", f"WITH {FILES_SQL} SELECT file_number || ':' || start_offset AS line FROM offsets")
def _(t):
    return pack_manifest(files_of(t))


@query("order_by_name", f"WITH {FILES_SQL} SELECT path, row_number() OVER (ORDER BY path) AS place FROM numbered")
def _(t):
    return assign_ids(numeric_name_filter(files_of(t)).select("path"), "place", order_by=["path"])


def ranges_of(t):
    files = files_of(t)
    total = file_manifest(files).first()["total_bytes"]
    return packed_ranges(pack_manifest(files), total)


@query("packed_ranges", f"WITH {FILES_SQL} SELECT file_number, start_offset, length FROM offsets")
def _(t):
    return ranges_of(t)


@query("packed_length", f"WITH {FILES_SQL} SELECT file_number, length FROM offsets")
def _(t):
    return ranges_of(t).select("file_number", "length")


@query("pack_compact", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT file_number, citation_id, md5(sentence) AS sentence_md5 FROM citations")
def _(t):
    path = scratch_path(t.spark, "packed")
    pack_compact(t.spark, written_files(t), path)
    return t.spark.read.parquet(path).select("file_number", "citation_id", F.md5("sentence").alias("sentence_md5"))


@query("distinct_files", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT DISTINCT file_number FROM citations")
def _(t):
    return distinct_files(document_citations(t))


@query("id_semi_filter", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT citation_id, uri FROM citations WHERE citation_id IN (SELECT doc_id FROM labels)")
def _(t):
    wanted = t.labels.select(F.col("doc_id").alias("citation_id"))
    return id_semi_filter(document_citations(t), wanted).select("citation_id", "uri")


@query(
    "citation_text_join",
    f"WITH {DOCUMENT_CITATIONS_SQL} SELECT citation_id, file_number, uri, md5(sentence) AS sentence_md5 FROM citations WHERE citation_id IN (SELECT doc_id FROM labels)",
)
def _(t):
    labelled = t.labels.select(F.col("doc_id").alias("citation_id")).distinct()
    wanted = labelled.withColumn("file_number", F.floor(F.col("citation_id") / 50))
    texts = citation_xml_read(t.spark, written_files(t))
    return citation_text_join(wanted, texts).select("citation_id", "file_number", "uri", F.md5("sentence").alias("sentence_md5"))


# --- stored tables ----------------------------------------------------------


def document_topics(t):
    return t.embeddings.select(
        F.col("vec_id").alias("topic_id"),
        F.concat(F.lit("topic "), "vec_id").alias("name"),
        (F.col("vec_id") * 10).alias("block_start"),
        (F.col("vec_id") * 10 + 10).alias("block_end"),
        F.col("vec_id").alias("article_id"),
        F.col("embedding").alias("topic_vector"),
    )


def sized(topics):
    return topics.select("topic_id", "name", "block_start", "block_end", F.size("topic_vector").cast("bigint").alias("size"))


TOPICS_SQL = "SELECT vec_id AS topic_id, 'topic ' || vec_id AS name, vec_id * 10 AS block_start, vec_id * 10 + 10 AS block_end, len(embedding) AS size FROM embeddings"


@query("topics_load", TOPICS_SQL)
def _(t):
    store = scratch_path(t.spark, "store")
    topics_write(document_topics(t), store, "first")
    return sized(topics_load(t.spark, store))


@query("append_topics", f"SELECT *, 'first' AS run FROM ({TOPICS_SQL}) WHERE topic_id IN (SELECT doc_id FROM labels) UNION ALL SELECT *, 'second' FROM ({TOPICS_SQL}) WHERE topic_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    store = scratch_path(t.spark, "store")
    labelled = t.labels.select(F.col("doc_id").alias("topic_id"))
    append_topics(t.spark, store, document_topics(t).join(labelled, "topic_id", "left_semi"), "first")
    both = append_topics(t.spark, store, document_topics(t).join(labelled, "topic_id", "left_anti"), "second")
    return both.select("topic_id", "name", "block_start", "block_end", F.size("topic_vector").cast("bigint").alias("size"), "run")


@query("citations_load", f"WITH {DOCUMENT_CITATIONS_SQL} SELECT citation_id, topic_id, file_number, uri, md5(sentence) AS sentence_md5, paragraph FROM citations")
def _(t):
    # A run without topics is one that died half-way: its citations must not show.
    store = scratch_path(t.spark, "store")
    citations_write(document_citations(t), store, "first")
    citations_write(document_citations(t), store, "died")
    topics_write(document_topics(t), store, "first")
    cites = citations_load(t.spark, store)
    return cites.select("citation_id", "topic_id", "file_number", "uri", F.md5("sentence").alias("sentence_md5"), "paragraph")


@query("store_counts", "SELECT (SELECT count(*) FROM embeddings) AS n_topics, (SELECT count(*) FROM documents) AS n_citations")
def _(t):
    return store_counts(document_topics(t), document_citations(t))


@query("assign_ids", "SELECT doc_id, 1000 + row_number() OVER (ORDER BY source, doc_id) AS topic_id FROM documents")
def _(t):
    return assign_ids(t.documents.select("source", "doc_id"), "topic_id", 1000, ["source", "doc_id"]).select("doc_id", "topic_id")


@query("assign_ids_many", "SELECT doc_id, 1000 + row_number() OVER (ORDER BY source, doc_id) AS topic_id FROM documents")
def _(t):
    return assign_ids(t.documents.select("source", "doc_id"), "topic_id", 1000, ["source", "doc_id"], small_bytes=0).select("doc_id", "topic_id")


@query("order_by_id", "SELECT vec_id AS topic_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings")
def _(t):
    return assign_ids(document_topics(t).select("topic_id"), "place", order_by=["topic_id"])


# --- checks of stored tables ------------------------------------------------


@query("check_unique_name", "SELECT text AS name, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    return check_unique_name(t.documents.select(F.col("text").alias("name")))


@query(
    "check_citation_fk",
    f"WITH {CITES_SQL} SELECT doc_id AS topic_id, count(*) AS n FROM cites WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id",
)
def _(t):
    articles = clean_markup(document_markup(t.documents))
    html = articles.select(F.col("article_id").alias("topic_id"), template_to_cite(F.col("markup")).alias("html"))
    return check_citation_fk(extract_citations(html), t.labels.select(F.col("doc_id").alias("topic_id")).distinct())


@query(
    "check_types",
    """SELECT 'doc_id' AS column_name, 0::BIGINT AS n_bad FROM documents GROUP BY 1
UNION ALL SELECT 'source', count(*) FROM documents WHERE NOT regexp_matches(source, '^[0-9]+$')
UNION ALL SELECT 'number', count(*) FROM documents WHERE NOT regexp_matches(replace(source, 'src1', ''), '^[0-9]+$')""",
)
def _(t):
    number = F.replace("source", F.lit("src1"), F.lit(""))
    raw = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", number.alias("number"))
    return check_types(raw, {"doc_id": "bigint", "source": "bigint", "number": "bigint"})
