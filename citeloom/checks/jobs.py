"""Checked queries: support, reports, streams, and the three jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks.inputs import (
    CITES_SQL,
    HTML_PARAGRAPH,
    LINES_SQL,
    TOPIC_TEXT_SQL,
    document_markup,
    embedding_sql,
    joined_sql,
    noisy_markup,
    titled,
    titled_sql,
    ARTICLE_TITLE_SQL,
    write_block_dump,
    write_dump_files,
)
from citeloom.checks.registry import query
from citeloom.checks.sources import FILES_SQL, document_topics, files_of, written_files
from citeloom.checks.text import CLAIM_CLEAN_SQL
from citeloom.checks.vectors import TOPK_SQL, MoodyEncoder, claims_of, topics_of
from citeloom.functions.html import cited_uris
from citeloom.functions.markup import markup_paragraphs, ref_rewrite, ref_strip, template_to_cite
from citeloom.operators.filters import ingest_outcomes, outcome_reason
from citeloom.operators.models import support_score
from citeloom.operators.similarity import topk_topics
from citeloom.operators.support import (
    citations_per_topic,
    claim_premise_pairs,
    premise_dedup,
    prune_to_topics,
    score_pairs,
    split_claims,
    support_nested,
    topic_citations,
)
from citeloom.plans.classify import classify_claims
from citeloom.plans.ingest import ingest_dump, ingest_progress
from citeloom.plans.pack import data_length, files_by_number, load_ranges, pack_files
from citeloom.session import scratch_path, stage
from citeloom.sources.citation_files import list_files
from citeloom.sources.colocated import colocated_citations, read_colocated, write_colocated
from citeloom.sources.dump import index_parse
from citeloom.sources.outcomes import run_report
from citeloom.sources.packed import packed_lookup
from citeloom.sources.stores import append_topics, citations_load, topics_load
from citeloom.sources.upkeep import merge_runs, vacuum
from citeloom.streaming.jobs import stream_claims, stream_classify, stream_ingest

# --- matches and citations: a document belongs to one of 500 topics ----------


def topic_cites(t):
    return t.documents.select(
        F.col("doc_id").alias("citation_id"),
        F.pmod("doc_id", F.lit(500)).alias("topic_id"),
        F.concat(F.lit("https://ex.org/"), "doc_id").alias("uri"),
        F.col("text").alias("sentence"),
    )


def matches_of(t):
    return stage(topk_topics(claims_of(t), topics_of(t)), "matches")


TOPIC_CITATIONS_SQL = f"""WITH {TOPK_SQL} SELECT claim_id, topic_id, rank::INTEGER AS rank, 'topic ' || topic_id AS name, doc_id AS citation_id,
  'https://ex.org/' || doc_id AS uri, length(text) AS n FROM matches JOIN documents ON doc_id % 500 = topic_id"""


def cited_rows(cited):
    return cited.select("claim_id", "topic_id", "rank", "name", "citation_id", "uri", F.length("sentence").cast("bigint").alias("n"))


@query("topic_citations", TOPIC_CITATIONS_SQL)
def _(t):
    return cited_rows(topic_citations(matches_of(t), document_topics(t), topic_cites(t)))


@query("topic_citations_many", TOPIC_CITATIONS_SQL)
def _(t):
    """The way of large tables, whatever their size: semi-join first, then joins by output."""
    matches = matches_of(t)
    cites = prune_to_topics(topic_cites(t), matches, pushed_ids=0)
    return cited_rows(topic_citations(matches, document_topics(t), stage(cites, "cites"), plain_bytes=0))


@query("topic_citations_colocated", TOPIC_CITATIONS_SQL)
def _(t):
    """From tables in buckets of the topic id; a few topics are too large for theirs."""
    path = scratch_path(t.spark, "colocated")
    cites = topic_cites(t)
    mean = max(1, t.documents.count() // 500)
    write_colocated(document_topics(t), cites, path, buckets=16, large_rows=mean)
    return cited_rows(colocated_citations(matches_of(t), read_colocated(t.spark, path)))


@query(
    "citations_per_topic",
    f"""WITH {TOPK_SQL} SELECT topic_id, (SELECT count(*) FROM documents WHERE doc_id % 500 = topic_id) AS n
FROM (SELECT DISTINCT topic_id FROM matches)""",
)
def _(t):
    return citations_per_topic(matches_of(t), topic_cites(t))


# --- support: a user's turn is the claim, the assistant's turns are its citations

TALK_SQL = f"""user_lines AS (
  SELECT conv_id, conv_id * 100 + turn AS claim_id, 0 AS line_no, {CLAIM_CLEAN_SQL.format(x="text")} AS hypothesis
  FROM conversations WHERE role = 'user'
), pairs AS (
  SELECT u.claim_id, u.line_no, u.hypothesis, c.conv_id * 100 + c.turn AS citation_id, 'https://ex.org/' || c.turn AS uri,
         c.text AS sentence, {CLAIM_CLEAN_SQL.format(x="c.text")} AS premise
  FROM user_lines u JOIN conversations c ON c.conv_id = u.conv_id AND c.role = 'assistant'
)"""


def scored_sql(pairs: str) -> str:
    """CTE ``scored``: the stand-in scorer's rule, then softmax."""
    return f"""shares AS (
  SELECT *, list_filter(list_distinct(string_split(hypothesis, ' ')), lambda x: x <> '') AS wanted FROM {pairs}
), logits AS (
  SELECT *, 4.0::DOUBLE * CASE WHEN len(wanted) = 0 THEN 0 ELSE
    len(list_intersect(wanted, string_split(premise, ' ')))::DOUBLE / len(wanted) END - 2 AS e FROM shares
), scored AS (
  SELECT *, exp(-e) / (exp(-e) + exp(e)) AS contra, exp(e) / (exp(-e) + exp(e)) AS entail FROM logits
)"""


def talk_pairs(t):
    claims = t.conversations.where("role = 'user'")
    ident = F.col("conv_id") * 100 + F.col("turn")
    lines = split_claims(claims.select(ident.alias("claim_id"), "text"))
    said = t.conversations.where("role = 'assistant'").select(
        "conv_id", ident.alias("citation_id"), F.concat(F.lit("https://ex.org/"), "turn").alias("uri"), F.col("text").alias("sentence")
    )
    cites = claims.select("conv_id", ident.alias("claim_id")).join(said, "conv_id").drop("conv_id")
    return claim_premise_pairs(lines, cites)


@query("claim_premise_pairs", f"WITH {TALK_SQL} SELECT claim_id, line_no, citation_id, uri, hypothesis, premise FROM pairs")
def _(t):
    return talk_pairs(t).select("claim_id", "line_no", "citation_id", "uri", "hypothesis", "premise")


@query("premise_dedup", f"WITH {TALK_SQL} SELECT DISTINCT claim_id, line_no, premise, hypothesis FROM pairs")
def _(t):
    return premise_dedup(talk_pairs(t))


@query(
    "support_score",
    f"WITH {TALK_SQL}, texts AS (SELECT DISTINCT premise, hypothesis FROM pairs), {scored_sql('texts')} "
    "SELECT premise, hypothesis, round(contra, 6) AS contra, round(entail, 6) AS entail FROM scored",
)
def _(t):
    texts = talk_pairs(t).select("premise", "hypothesis").distinct()
    return support_score(texts).select("premise", "hypothesis", F.round("contra", 6).alias("contra"), F.round("entail", 6).alias("entail"))


SUPPORT_SQL = f"WITH {TALK_SQL}, {scored_sql('pairs')} SELECT claim_id, line_no, citation_id, uri, round(contra, 6) AS contra, round(entail, 6) AS entail FROM scored"


@query("score_rejoin", SUPPORT_SQL)
def _(t):
    scored = score_pairs(stage(talk_pairs(t), "pairs"))
    return scored.select("claim_id", "line_no", "citation_id", "uri", F.round("contra", 6).alias("contra"), F.round("entail", 6).alias("entail"))


@query("score_store", SUPPORT_SQL)
def _(t):
    """Scored by a first run, then asked again of a scorer that must not be called."""

    class Never:
        def logits(self, prompts):
            raise RuntimeError("this pair has a score")

    pairs, store = stage(talk_pairs(t), "pairs"), scratch_path(t.spark, "scores")
    score_pairs(pairs, store=store, run="first")
    scored = score_pairs(pairs, Never, store=store, run="second")
    return scored.select("claim_id", "line_no", "citation_id", "uri", F.round("contra", 6).alias("contra"), F.round("entail", 6).alias("entail"))


@query("support_nested", SUPPORT_SQL)
def _(t):
    nested = support_nested(stage(score_pairs(stage(talk_pairs(t), "pairs")), "scored"), chunk_rows=2)
    rows = nested.select("claim_id", "line_no", F.explode("support").alias("s"))
    return rows.select("claim_id", "line_no", "s.citation_id", "s.uri", F.round("s.contra", 6).alias("contra"), F.round("s.entail", 6).alias("entail"))


# --- reports ----------------------------------------------------------------


@query(
    "ingest_progress",
    f"""WITH {FILES_SQL}, s AS (SELECT count(*) AS done, sum(length) // count(*) AS mean, (SELECT count(*) FROM files) AS total FROM numbered)
SELECT round(done / total * 100.0, 1) AS done_percent, mean::BIGINT AS mean_bytes, (mean * total)::BIGINT AS projected_bytes FROM s""",
)
def _(t):
    files = files_of(t)
    done = files.where(F.rlike("path", F.lit(r"/\d+\.xml")))
    return ingest_progress(done, files.count())


# Stored already: documents with a label. Page missing: source src4. Redirect: src1.
# Emptied: src5. The encoder fails on texts with "@" and gives no vector for texts without a
# word that counts.
OUTCOMES_SQL = f"""WITH {TOPIC_TEXT_SQL}, {embedding_sql('topic_text', 'doc_id', 'text')}, a AS (
  SELECT d.doc_id, source, tt.text, {titled_sql('doc_id', "source || ':' || doc_id")} AS title, d.doc_id IN (SELECT doc_id FROM labels) AS present
  FROM documents d LEFT JOIN topic_text tt USING (doc_id)
), cited AS (
  SELECT doc_id FROM (WITH {CITES_SQL} SELECT DISTINCT doc_id FROM cites)
), r AS (
  SELECT CASE WHEN present THEN 'present'
    WHEN list_bool_or(list_transform({ARTICLE_TITLE_SQL}, lambda p: starts_with(title, p))) THEN 'namespace'
    WHEN source = 'src4' THEN 'missing page' WHEN source = 'src1' THEN 'redirect' WHEN source = 'src5' THEN 'empty'
    WHEN doc_id NOT IN (SELECT doc_id FROM cited) THEN 'no cites' WHEN contains(text, '@') THEN 'embedding failed'
    WHEN doc_id NOT IN (SELECT doc_id FROM topic_text_parts) THEN 'embedding rejected' ELSE 'stored' END AS reason
  FROM a
)"""


def outcome_run(t, *runs) -> str:
    """A store after ``runs`` over a dump where pages fail in every way."""
    markup = (
        F.when(F.col("source") == "src1", F.concat(F.lit("#REDIRECT "), "markup"))
        .when(F.col("source") == "src5", F.lit('<ref name="a" />'))
        .otherwise(F.col("markup"))
    )
    made = document_markup(t.documents).withColumnRenamed("article_id", "doc_id").drop("title")
    articles = t.documents.join(made, "doc_id").select(
        F.col("doc_id").alias("article_id"),
        titled(F.col("doc_id"), F.concat_ws(":", "source", "doc_id")).alias("title"),
        markup.alias("markup"),
        "source",
    )
    lines, lengths = write_block_dump(articles.where("source <> 'src4'").drop("source"))
    index = index_parse(lines)
    # The index names the missing pages too, in the first block.
    block = F.broadcast(index.agg(F.min(F.struct("dump_path", "block_start")).alias("b")))
    missing = articles.where("source = 'src4'").join(block).select("b.dump_path", "b.block_start", "article_id", "title")
    store = scratch_path(t.spark, "store")
    known = articles.join(t.labels.select(F.col("doc_id").alias("article_id")).distinct(), "article_id", "left_semi")
    none = F.lit(None).cast("bigint")
    known = known.select(F.col("article_id").alias("topic_id"), F.col("title").alias("name"), none.alias("block_start"), none.alias("block_end"), "article_id", F.lit(None).cast("array<float>").alias("topic_vector"))
    append_topics(t.spark, store, known, "labelled")
    for run in runs:
        ingest_dump(index.unionByName(missing.select(index.columns)), lengths, store, run, MoodyEncoder)
    return store


@query("ingest_outcomes", OUTCOMES_SQL + " SELECT reason, count(*) AS n FROM r GROUP BY reason")
def _(t):
    return run_report(t.spark, outcome_run(t, "first"), "first")


@query(
    "ingest_outcomes_again",
    OUTCOMES_SQL
    + """ SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN reason = 'stored' THEN 'present' WHEN reason IN ('redirect', 'empty', 'no cites') THEN 'seen before' ELSE reason END AS reason FROM r
) GROUP BY reason""",
)
def _(t):
    """A second run reads what the first wrote: only missing and failed pages are tried again."""
    return run_report(t.spark, outcome_run(t, "first", "second"), "second")


@query(
    "outcome_reason",
    f"""WITH {LINES_SQL}, cited AS (
  SELECT doc_id FROM (WITH {CITES_SQL} SELECT DISTINCT doc_id FROM cites)
), r AS (
  SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'present' WHEN doc_id NOT IN (SELECT doc_id FROM cited) THEN 'no cites' ELSE 'stored' END AS reason FROM documents
) SELECT reason, count(*) AS n FROM r GROUP BY reason""",
)
def _(t):
    made = document_markup(t.documents).withColumnRenamed("article_id", "doc_id")
    labelled = t.labels.select("doc_id", F.lit(True).alias("present")).distinct()
    articles = made.join(labelled, "doc_id", "left").withColumn("clean", ref_strip(ref_rewrite(F.col("markup"))))
    uris = F.flatten(F.transform(markup_paragraphs(template_to_cite(F.col("clean"))), cited_uris))
    counted = articles.select(F.coalesce("present", F.lit(False)).alias("present"), "title", "markup", "clean", F.size(uris).alias("n_cites"))
    reason = outcome_reason(*[F.col(c) for c in ("present", "title", "markup", "clean", "n_cites")], F.lit(True))
    return ingest_outcomes(counted.select(reason.alias("reason")))


# --- jobs -------------------------------------------------------------------

# What the ingest stores: citations of documents that have one and whose topic text
# gives a vector, with the three largest parts of that vector.
STORED_SQL = f"""{CITES_SQL}, {TOPIC_TEXT_SQL.replace(LINES_SQL + ', ', '')}, {embedding_sql('topic_text', 'doc_id', 'text')}"""

INGESTED_SQL = f"""WITH {STORED_SQL}, totals AS (
  SELECT doc_id, count(*) AS n_parts, round(sum(abs(value::DOUBLE)), 5) AS weight FROM topic_text_parts GROUP BY doc_id
) SELECT d.source || ':' || c.doc_id AS name, c.doc_id AS article_id, c.uri, c.sentence, md5(c.paragraph) AS paragraph_md5,
  count(*) AS copies, n_parts, weight
FROM cites c JOIN totals USING (doc_id) JOIN documents d USING (doc_id) GROUP BY ALL"""


def stored_rows(spark, store):
    """Stored citations with what their topic looks like, ids left out."""
    topics, citations = topics_load(spark, store), citations_load(spark, store)
    shape = topics.select(
        "topic_id",
        "name",
        "article_id",
        F.size(F.filter("topic_vector", lambda x: x != 0)).cast("bigint").alias("n_parts"),
        F.round(F.aggregate("topic_vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 5).alias("weight"),
    )
    return (
        citations.join(shape, "topic_id")
        .groupBy("name", "article_id", "uri", "sentence", F.md5("paragraph").alias("paragraph_md5"), "n_parts", "weight")
        .agg(F.count("*").alias("copies"))
    )


def ingested_store(t) -> str:
    lines, lengths = write_block_dump(noisy_markup(t.documents))
    store = scratch_path(t.spark, "store")
    ingest_dump(index_parse(lines), lengths, store, "first")
    return store


@query("ingest_articles", INGESTED_SQL)
def _(t):
    return stored_rows(t.spark, ingested_store(t))


@query(
    "ingest_again",
    f"WITH {STORED_SQL} SELECT count(DISTINCT doc_id) AS n_topics, count(*) AS n_citations, count(DISTINCT doc_id) AS last_topic_id, count(*) AS last_citation_id FROM cites WHERE doc_id IN (SELECT doc_id FROM topic_text_parts)",
)
def _(t):
    # The second run finds everything stored; ids are dense from 1.
    lines, lengths = write_block_dump(noisy_markup(t.documents))
    store = scratch_path(t.spark, "store")
    for run in ("first", "second"):
        ingest_dump(index_parse(lines), lengths, store, run)
    topics = topics_load(t.spark, store).agg(F.count("*").alias("n_topics"), F.max("topic_id").alias("last_topic_id"))
    cites = citations_load(t.spark, store).agg(F.count("*").alias("n_citations"), F.max("citation_id").alias("last_citation_id"))
    return topics.select(
        "n_topics",
        cites.select("n_citations").scalar().alias("n_citations"),
        "last_topic_id",
        cites.select("last_citation_id").scalar().alias("last_citation_id"),
    )


@query(
    "pack_citations",
    """SELECT doc_id // 50 AS file_number, true AS tiles, count(*) AS n, md5(string_agg(doc_id || 'https://ex.org/?a=1&b=' || doc_id || md5(text), '' ORDER BY doc_id)) AS content_md5
FROM documents GROUP BY 1""",
)
def _(t):
    # Sizes of compressed files are not a matter of SQL: check that the ranges read back from
    # the manifest lie end to end and cover the data. Content is looked up by number, in
    # packed files of a few numbers each.
    files_path, packed, index = written_files(t), scratch_path(t.spark, "packed"), scratch_path(t.spark, "manifest")
    places = scratch_path(t.spark, "places")
    pack_files(t.spark, files_path, packed, index, places, packed_bytes=1 << 17)
    sizes = files_by_number(list_files(t.spark, files_path))
    ranges = load_ranges(t.spark, index, data_length(sizes))
    true_sizes = sizes.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("file_number"), F.col("length").alias("size"))
    tiled = ranges.join(true_sizes, "file_number").select("file_number", (F.col("length") == F.col("size")).alias("tiles"))
    said = F.struct("citation_id", F.concat("citation_id", "uri", F.md5("sentence")).alias("text"))
    looked_up = packed_lookup(t.spark, places, ranges.select("file_number")).groupBy("file_number").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(said)).alias("rows"))
    content = looked_up.select("file_number", "n", F.md5(F.array_join(F.col("rows.text"), "")).alias("content_md5"))
    return tiled.join(content, "file_number")


def classify_inputs(t):
    """Claims, topics and citations of an ingested store."""
    store = ingested_store(t)
    topics = topics_load(t.spark, store)
    # Equal vectors tie by topic id, which follows the scan here: number by article.
    citations = citations_load(t.spark, store).join(topics.select("topic_id", "article_id"), "topic_id")
    citations = citations.drop("topic_id").withColumnRenamed("article_id", "topic_id")
    topics = topics.withColumn("topic_id", F.col("article_id"))
    claims = t.conversations.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), "text")
    return claims, topics, citations


def counted_scores(scored):
    return scored.groupBy(
        "claim_id",
        F.col("topic_id").alias("article_id"),
        "uri",
        F.round("sim", 6).alias("sim"),
        F.round("contra", 6).alias("contra"),
        F.round("entail", 6).alias("entail"),
    ).agg(F.count("*").alias("n"))


CLASSIFIED_SQL = f"""WITH {STORED_SQL}, claims AS (SELECT conv_id * 100 + turn AS claim_id, text FROM conversations WHERE role = 'user'),
{embedding_sql('claims', 'claim_id', 'text')}, topics AS (
  SELECT p.* FROM topic_text_parts p WHERE doc_id IN (SELECT doc_id FROM cites)
), sims AS (
  SELECT c.claim_id, t.doc_id, round(sum(c.value::DOUBLE * t.value::DOUBLE), 9) AS sim
  FROM claims_parts c JOIN topics t USING (bucket) GROUP BY 1, 2
), matches AS (
  SELECT * FROM sims WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY sim DESC, doc_id) <= 5
), pairs AS (
  SELECT m.claim_id, m.doc_id, m.sim, c.uri, c.para_no, c.cite_no, {CLAIM_CLEAN_SQL.format(x="l.text")} AS hypothesis, {CLAIM_CLEAN_SQL.format(x="c.sentence")} AS premise
  FROM matches m JOIN cites c USING (doc_id) JOIN claims l ON l.claim_id = m.claim_id
), {scored_sql('pairs')}
SELECT claim_id, doc_id AS article_id, uri, round(sim, 6) AS sim, round(contra, 6) AS contra, round(entail, 6) AS entail, count(*) AS n FROM scored GROUP BY ALL"""


@query("classify_claims", CLASSIFIED_SQL)
def _(t):
    claims, topics, citations = classify_inputs(t)
    return counted_scores(classify_claims(claims, topics, citations))


# --- streams ----------------------------------------------------------------


@query("stream_claims", f"WITH {TOPK_SQL} SELECT claim_id, topic_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM matches")
def _(t):
    source = scratch_path(t.spark, "claims")
    claims = claims_of(t)
    claims.repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = scratch_path(t.spark, "answers")
    stream_claims(stream, document_topics(t), out, scratch_path(t.spark, "position")).awaitTermination()
    return t.spark.read.parquet(out).select("claim_id", "topic_id", F.round("sim", 6).alias("sim"), "rank")


@query("stream_ingest", INGESTED_SQL)
def _(t):
    source, files = write_dump_files(t.documents, noisy_markup(t.documents), 3)
    store = scratch_path(t.spark, "store")
    stream = t.spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files).text(source)
    stream_ingest(stream, store, scratch_path(t.spark, "position")).awaitTermination()
    return stored_rows(t.spark, store)


@query("stream_ingest_merged", INGESTED_SQL)
def _(t):
    """A run per batch of files, then merged into one, then swept."""
    source, files = write_dump_files(t.documents, noisy_markup(t.documents), 6)
    store = scratch_path(t.spark, "store")
    stream = t.spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files).text(source)
    stream_ingest(stream, store, scratch_path(t.spark, "position")).awaitTermination()
    if merge_runs(t.spark, store, least=2) < 2 or vacuum(t.spark, store) < 2:
        raise AssertionError("no run was merged")
    return stored_rows(t.spark, store)


@query("stream_ingest_twice", INGESTED_SQL)
def _(t):
    """Two streams with positions of their own into one store: each adds what it alone has."""
    store = scratch_path(t.spark, "store")
    docs = noisy_markup(t.documents)
    halves = (F.pmod("article_id", F.lit(2)) == 0, F.lit(True))
    for half in halves:
        source, _ = write_dump_files(t.documents, docs.where(half), 2)
        stream = t.spark.readStream.option("lineSep", "</page>").text(source)
        stream_ingest(stream, store, scratch_path(t.spark, "position")).awaitTermination()
    return stored_rows(t.spark, store)


@query("stream_ingest_at_once", INGESTED_SQL)
def _(t):
    """Two streams that run at the same time into one store: ids stay apart."""
    store = scratch_path(t.spark, "store")
    docs = noisy_markup(t.documents)
    running = []
    for half in range(2):
        source, files = write_dump_files(t.documents, docs.where(F.pmod("article_id", F.lit(2)) == half), 2)
        stream = t.spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files).text(source)
        running.append(stream_ingest(stream, store, scratch_path(t.spark, "position")))
    for one in running:
        one.awaitTermination()
    return stored_rows(t.spark, store)


@query("stream_classify", CLASSIFIED_SQL)
def _(t):
    claims, topics, citations = classify_inputs(t)
    source, out = scratch_path(t.spark, "claims"), scratch_path(t.spark, "answers")
    claims.repartition(2).write.parquet(source)
    stream = t.spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_classify(stream, topics, citations, out, scratch_path(t.spark, "position")).awaitTermination()
    return counted_scores(t.spark.read.parquet(out))
