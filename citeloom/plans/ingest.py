"""Dump to topics and citations.

Order of work: names are filtered on the index, which is small; only blocks with
something left are read; redirects and articles without citations go before the
encoder runs. Page text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.markup import is_redirect, markup_to_html
from citeloom.functions.text import topic_text_clean, whitespace_collapse
from citeloom.functions.vectors import has_unit_norm, has_valid_size
from citeloom.operators.cites import extract_citations, has_cites
from citeloom.operators.filters import (
    first_per_title,
    is_article_title,
)
from citeloom.operators.models import Encoder, HashingEncoder, embed_column
from citeloom.operators.ordered import assign_ids, read_with_ids
from citeloom.session import broadcast_small, scratch, scratch_path, stage
from citeloom.sources.dump import articles_per_block, block_table, dump_read_blocks
from citeloom.sources.outcomes import lasting_outcomes, outcomes_write
from citeloom.sources.register import reserve
from citeloom.sources.stores import (
    CITATIONS_SCHEMA,
    TOPICS_SCHEMA,
    citations_load,
    citations_write,
    highest_id,
    topics_load,
    topics_withdraw,
    topics_write,
)

PAGE_COLUMNS = ["dump_path", "block_start", "block_end", "file_number", "article_id", "title"]


def judge_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``markup`` to ``html`` and the ``reason`` that stops a page, null for a cited
    article; other pages keep no text.

    The HTML is an element of an exploded one-element array: filters and further columns
    on it would otherwise be pushed below and compute it again.
    """
    kept = [c for c in pages.columns if c != "markup"]
    article = F.col("markup").isNotNull() & ~is_redirect(F.col("markup"))
    html = F.explode(F.array(F.when(article, markup_to_html(F.col("markup"))))).alias("html")
    reason = (
        F.when(F.col("markup").isNull(), "missing page")
        .when(is_redirect(F.col("markup")), "redirect")
        .when(~F.rlike("html", F.lit(r"\S")), "empty")
        .when(~has_cites(F.col("html")), "no cites")
    )
    judged = pages.select(*kept, "markup", html).select(*kept, F.explode(F.array(F.struct(reason.alias("reason"), "html"))).alias("_page"))
    return judged.select(*kept, "_page.reason", F.when(F.col("_page.reason").isNull(), F.col("_page.html")).alias("html"))


def embed_judged(judged: DataFrame, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Adds ``topic_vector`` and ``detail``. Pages that are out cost no call of the encoder; one
    without a usable vector gets its ``reason``."""
    kept = [c for c in judged.columns if c != "reason"]
    embedded = judged.withColumn("_embed", embed_column(whitespace_collapse(topic_text_clean(F.col("html"))), make_encoder))
    vector = F.col("_embed.vector")
    failed = F.when(vector.isNull(), "embedding failed").when(~(has_valid_size(vector) & has_unit_norm(vector)), "embedding rejected")
    return embedded.select(*kept, F.coalesce("reason", failed).alias("reason"), vector.alias("topic_vector"), F.col("_embed.error").alias("detail"))


def ingest_pages(
    pages: DataFrame,
    store: str,
    run: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    passed_over: DataFrame | None = None,
) -> None:
    """Adds new pages to the store as one run.

    ``pages``: ``dump_path, block_start, block_end, file_number, article_id, title, markup``,
    one row per title, none of them stored yet. ``passed_over``: articles that were not read,
    with their ``reason``, for the run's outcomes. Repeating a run replaces it.
    """
    spark = pages.sparkSession
    topics_withdraw(spark, store, run)

    # The encoder's output is staged once, articles and dropped pages in folders apart; all
    # three tables are made from it.
    staged = scratch_path(spark, "articles")
    judged = embed_judged(judge_pages(pages.select(*PAGE_COLUMNS, "markup")), make_encoder)
    judged.withColumn("kept", F.col("reason").isNull()).write.partitionBy("kept").parquet(staged)
    everything = spark.read.schema(judged.schema.add("kept", "boolean")).parquet(staged)
    dropped = everything.where("not kept").select("dump_path", "block_start", "article_id", "title", "reason", "detail")
    n_articles = everything.where("kept").count()
    if passed_over is not None:
        dropped = dropped.unionByName(passed_over.select("dump_path", "block_start", "article_id", "title", "reason", F.lit(None).cast("string").alias("detail")))

    if n_articles:
        last_topic = reserve(spark, store, "topic_id", run, n_articles, lambda: highest_id(topics_load(spark, store), "topic_id"))
        articles = read_with_ids(spark, f"{staged}/kept=true", "topic_id", last_topic)
        cites_staged = scratch_path(spark, "citations")
        extract_citations(articles.select("topic_id", "file_number", "html")).write.parquet(cites_staged)
        n_cites = spark.read.parquet(cites_staged).count()
        last_citation = reserve(spark, store, "citation_id", run, n_cites, lambda: highest_id(citations_load(spark, store), "citation_id"))
        citations = read_with_ids(spark, cites_staged, "citation_id", last_citation)
    else:
        articles = spark.createDataFrame([], TOPICS_SCHEMA).withColumnRenamed("name", "title")
        citations = spark.createDataFrame([], CITATIONS_SCHEMA)
    citations_write(citations, store, run)
    outcomes_write(dropped, store, run)
    topics_write(articles.withColumnRenamed("title", "name"), store, run)


def judge_index(index: DataFrame, store: str, run: str) -> DataFrame:
    """Index rows with the ``reason`` not to read them, null for those to read: the first of a
    title that is an article's and not stored, unless an earlier run has seen that the page
    is of no use. Only names and ids are grouped and joined."""
    spark = index.sparkSession
    topics = topics_load(spark, store).where(F.col("run") != run)
    # Null names are no articles; they must not meet each other in the joins.
    usable = index.where("title is not null and article_id is not null and block_start is not null")
    unusable = index.where("title is null or article_id is null or block_start is null")
    lowest = usable.groupBy("title").agg(F.min("article_id").alias("_lowest"))
    stored = topics.select(F.col("name").alias("title"), F.lit(True).alias("_present")).distinct()
    seen = lasting_outcomes(spark, store, run).withColumn("_seen", F.lit(True))
    reason = (
        F.when(F.col("_present"), "present")
        .when(~is_article_title(F.col("title")), "namespace")
        .when(F.col("article_id") != F.col("_lowest"), "title repeated")
        .when(F.col("_seen"), "seen before")
    )
    joined = usable.join(lowest.join(stored, "title", "left"), "title").join(seen, ["dump_path", "block_start", "article_id"], "left")
    judged = joined.select(*index.columns, reason.alias("reason"))
    return judged.unionByName(unusable.select(*index.columns, F.lit("index line").alias("reason")))


def pages_to_read(index: DataFrame, lengths: DataFrame, store: str, run: str) -> DataFrame:
    """Blocks with the articles wanted from them; adds ``file_number``."""
    return _blocks_to_read(stage(judge_index(index, store, run), "judged"), index, lengths, store, run)


def _blocks_to_read(judged: DataFrame, index: DataFrame, lengths: DataFrame, store: str, run: str) -> DataFrame:
    spark = index.sparkSession
    # Copies of a whole index row are one page.
    wanted = stage(first_per_title(judged.where("reason is null").drop("reason")), "wanted")
    blocks = block_table(index, lengths)
    todo = stage(blocks.join(wanted.select("dump_path", "block_start").distinct(), ["dump_path", "block_start"], "left_semi"), "todo")
    last_file = reserve(spark, store, "file_number", run, todo.count(), lambda: highest_id(citations_load(spark, store), "file_number"))
    numbered = assign_ids(todo, "file_number", last_file, ["dump_path", "block_start"])
    return stage(articles_per_block(wanted, numbered), "blocks")


def ingest_dump(
    index: DataFrame,
    lengths: DataFrame,
    store: str,
    run: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
) -> None:
    """Reads what the store lacks. Running it again on the same dump adds nothing, and reads
    only what was missing or failed. ``sources.outcomes`` tells what became of all others.

    ``index``: ``dump_path, block_start, article_id, title``; ``lengths``:
    ``dump_path, data_len``.
    """
    with scratch(index.sparkSession):
        judged = stage(judge_index(index, store, run), "judged")
        pages = dump_read_blocks(_blocks_to_read(judged, index, lengths, store, run))
        ingest_pages(pages, store, run, make_encoder, passed_over=judged.where("reason is not null"))


#: Page names as a stream's state and a scan's title checks see them.
NAMES_SCHEMA = "title string, article_id bigint, path string, reason string, copies bigint"


def scan_reason() -> Column:
    """Why a scanned page (``article_id, title, markup``) need not be asked for by name."""
    return (
        F.when(F.col("title").isNull() | F.col("article_id").isNull(), "no title or id")
        .when(F.col("markup").isNull(), "missing page")
        .when(~is_article_title(F.col("title")), "namespace")
        .when(is_redirect(F.col("markup")), "redirect")
    )


def ingest_chosen(
    pages: DataFrame, names: DataFrame, store: str, run: str, make_encoder: Callable[[], Encoder] = HashingEncoder
) -> None:
    """Of ``pages`` (``article_id, title, markup``) those that ``names`` (``NAMES_SCHEMA``, staged)
    has without a reason, as one run; one citation file number for all of them. The other
    names are the run's outcomes. No text is shuffled but that of pages that repeat both
    title and id: names come to the pages as a slim, size-checked table."""
    spark = pages.sparkSession
    file_number = 1 + reserve(spark, store, "file_number", run, 1, lambda: highest_id(citations_load(spark, store), "file_number"))
    wanted = names.where("reason is null").select("title", "article_id", "copies")
    found = pages.join(broadcast_small(wanted), ["title", "article_id"])
    once = found.where("copies = 1")
    repeated = found.where("copies > 1").dropDuplicates(["title", "article_id"])
    none = F.lit(None).cast("bigint")
    full = once.unionByName(repeated).select(
        F.lit(None).cast("string").alias("dump_path"),
        "article_id",
        "title",
        "markup",
        none.alias("block_start"),
        none.alias("block_end"),
        F.lit(file_number).cast("bigint").alias("file_number"),
    )
    passed_over = names.where("reason is not null").select(F.lit(None).cast("string").alias("dump_path"), none.alias("block_start"), "article_id", "title", "reason")
    ingest_pages(full, store, run, make_encoder, passed_over)


def ingest_scan(
    spark: SparkSession, pages: DataFrame, store: str, run: str, make_encoder: Callable[[], Encoder] = HashingEncoder
) -> None:
    """The same for pages that come without an index (``article_id, title, markup``)."""
    with scratch(spark):
        # Staged, as the title checks read names and texts apart.
        staged = stage(pages.select("article_id", "title", "markup", scan_reason().alias("reason")), "pages")
        names = staged.where("reason is null").groupBy("title", "article_id").agg(F.count("*").alias("copies"))
        stored = topics_load(spark, store).where(F.col("run") != run).select(F.col("name").alias("title"), F.lit(True).alias("_present")).distinct()
        known = names.groupBy("title").agg(F.min("article_id").alias("_lowest")).join(stored, "title", "left")
        stopped = F.when(F.col("_present"), "present").when(F.col("article_id") != F.col("_lowest"), "title repeated")
        nowhere = F.lit(None).cast("string")
        judged = names.join(known, "title").select("title", "article_id", nowhere.alias("path"), stopped.alias("reason"), "copies")
        others = staged.where("reason is not null").select("title", "article_id", nowhere.alias("path"), "reason", F.lit(1).cast("bigint").alias("copies"))
        ingest_chosen(staged.drop("reason"), stage(judged.unionByName(others), "names"), store, run, make_encoder)


def ingest_progress(outputs: DataFrame, total_blocks: int) -> DataFrame:
    """Done share in percent, mean bytes and projected final bytes from the sizes of
    the files written so far (``length``)."""
    done = F.count("*")
    mean = F.floor(F.sum("length") / F.greatest(done, F.lit(1)))
    return outputs.agg(
        F.round(done / F.lit(total_blocks) * 100.0, 1).alias("done_percent"),
        mean.alias("mean_bytes"),
        (mean * F.lit(total_blocks)).alias("projected_bytes"),
    )
