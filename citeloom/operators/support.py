"""Matched topics to citations, to scored support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import claim_clean, claim_lines
from citeloom.operators.models import OverlapScorer, Scorer, support_score
from citeloom.operators.skew import PLAIN_JOIN_BYTES, salted_join
from citeloom.session import broadcast_small, stage
from citeloom.sources.scores import pair_key, scores_load, scores_write

# Nested lists are cut into chunks of about this many rows, so that the citations of
# one very popular article never have to fit into a single row.
CHUNK_ROWS = 1000

# Up to this many topic ids are put into the scan itself, where they prune row groups.
PUSHED_IDS = 1000


def id_semi_filter(citations: DataFrame, ids: DataFrame) -> DataFrame:
    """Citations whose ``citation_id`` is asked for."""
    return citations.join(ids.select("citation_id"), "citation_id", "left_semi")


def citation_text_join(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Sentence and URI for (``file_number``, ``citation_id``) rows."""
    return wanted.join(texts.select("file_number", "citation_id", "uri", "sentence"), ["file_number", "citation_id"])


def distinct_files(citations: DataFrame) -> DataFrame:
    return citations.select("file_number").distinct()


def prune_to_topics(citations: DataFrame, matches: DataFrame, pushed_ids: int = PUSHED_IDS) -> DataFrame:
    """Citations of the matched topics only. Few ids go into the scan; more are a semi-join,
    broadcast while they are counted as few enough, so that texts of other topics go before
    anything is shuffled.

    ``matches`` should be a staged table: it is read more than once.
    """
    matched = matches.select("topic_id").distinct()
    ids = [r[0] for r in matched.limit(pushed_ids + 1).collect()]
    if len(ids) <= pushed_ids:
        return citations.where(F.col("topic_id").isin(ids))
    return citations.join(broadcast_small(stage(matched, "matched")), "topic_id", "left_semi")


def topic_citations(matches: DataFrame, topics: DataFrame, citations: DataFrame, plain_bytes: int = PLAIN_JOIN_BYTES) -> DataFrame:
    """Each match with every citation of its topic and the article name:
    ``claim_id, topic_id, sim, rank, name, citation_id, uri, sentence``. Tables whose estimated
    size is above ``plain_bytes`` are joined evenly, whatever share a topic has."""
    named = salted_join(matches, topics.select("topic_id", "name"), ["topic_id"], ["claim_id"], plain_bytes=plain_bytes)
    cites = citations.select("topic_id", "citation_id", "uri", "sentence")
    joined = salted_join(cites, named, ["topic_id"], ["citation_id"], ["claim_id"], plain_bytes=plain_bytes)
    return joined.select("claim_id", "topic_id", "sim", "rank", "name", "citation_id", "uri", "sentence")


def citations_per_topic(matches: DataFrame, citations: DataFrame) -> DataFrame:
    """``topic_id, n`` per matched topic; zero when it has no citation."""
    counts = citations.groupBy("topic_id").agg(F.count("*").alias("_n"))
    return (
        matches.select("topic_id")
        .distinct()
        .join(counts, "topic_id", "left")
        .select("topic_id", F.coalesce("_n", F.lit(0)).alias("n"))
    )


def split_claims(claims: DataFrame) -> DataFrame:
    """``claim_id, line_no, hypothesis`` per claim line, cleaned."""
    return claims.select("claim_id", F.posexplode(claim_lines(F.col("text"))).alias("line_no", "line")).select(
        "claim_id", "line_no", claim_clean(F.col("line")).alias("hypothesis")
    )


def claim_premise_pairs(lines: DataFrame, citations: DataFrame) -> DataFrame:
    """Every claim line with every citation of its claim; adds the clean ``premise``."""
    premises = citations.withColumn("premise", claim_clean(F.col("sentence")))
    return salted_join(premises, lines, ["claim_id"], ["citation_id"], ["line_no"])


def premise_dedup(pairs: DataFrame) -> DataFrame:
    """One row per claim line and clean premise. ``score_pairs`` goes further and also
    shares scores between claims."""
    return pairs.select("claim_id", "line_no", "premise", "hypothesis").distinct()


def score_rejoin(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of the distinct texts put back on every citation, by the pair's key: texts are
    not compared or shuffled for it."""
    key = pair_key(F.col("premise"), F.col("hypothesis")).alias("_pair")
    columns = ["contra", "entail", *[c for c in scored.columns if c == "error"]]
    scores = scored.select(F.col("_pair") if "_pair" in scored.columns else key, *columns)
    return salted_join(pairs.select("*", key), scores, ["_pair"], ["claim_id", "citation_id"]).drop("_pair")


def score_pairs(
    pairs: DataFrame,
    make_scorer: Callable[[], Scorer] = OverlapScorer,
    keep_failures: bool = False,
    store: str | None = None,
    run: str | None = None,
) -> DataFrame:
    """Adds ``contra`` and ``entail``. Each distinct text pair is scored once, also
    when several claims or citations share it. A pair that cannot be scored ends the job,
    or, with ``keep_failures``, has null scores and says why in ``error``.

    With a ``store`` the pairs that it has scores of are not given to the model; those of the
    others are added to it as ``run``. ``pairs`` should be a staged table: it is read more
    than once.
    """
    key = pair_key(F.col("premise"), F.col("hypothesis"))
    texts = pairs.select("premise", "hypothesis").distinct().withColumn("_pair", key)
    if store is not None:
        if run is None:
            raise ValueError("scores are stored by run: give its name")
        known = stage(scores_load(pairs.sparkSession, store, run).withColumnRenamed("pair", "_pair"), "known-scores")
        texts = texts.join(known, "_pair", "left_anti")
    # A fixed number of tasks: an adaptive shuffle goes by bytes and would give few
    # tasks many calls of a slow model.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = support_score(texts.repartition(tasks, "_pair"), make_scorer, keep_failures=keep_failures)
    if store is None:
        return score_rejoin(pairs, scored)
    # Staged, as the store and the result are made from one call.
    scored = stage(scored.drop("premise", "hypothesis"), "scores")
    scores_write(scored.where("contra is not null").withColumnRenamed("_pair", "pair"), store, run)
    return score_rejoin(pairs, scored.unionByName(known, allowMissingColumns=True))


def support_nested(scored: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Support list per claim line: ``claim_id, line_no, n_support, chunk_no,
    support``. A line with few citations is one row; a long list is spread over
    chunks by citation id, all of them kept."""
    # Texts are shuffled once, into their lists: only the long lines are looked up, a slim table.
    line = ["claim_id", "line_no"]
    sizes = scored.groupBy(*line).agg(F.count("*").alias("_size")).where(F.col("_size") > chunk_rows)
    long = broadcast_small(stage(sizes, "long-lines").select(*[F.col(c).alias(f"_{c}") for c in line], "_size"))
    keyed = scored.join(long, F.col("claim_id").eqNullSafe(F.col("_claim_id")) & F.col("line_no").eqNullSafe(F.col("_line_no")), "left")
    chunks = F.ceil(F.coalesce("_size", F.lit(1)) / F.lit(chunk_rows))
    item = F.struct("citation_id", "sentence", "uri", "contra", "entail")
    return (
        keyed.withColumn("chunk_no", F.pmod(F.xxhash64("citation_id"), chunks).cast("int"))
        .groupBy(*line, "_size", "chunk_no")
        .agg(F.sort_array(F.collect_list(item)).alias("support"))
        .select(*line, F.coalesce("_size", F.size("support").cast("bigint")).alias("n_support"), "chunk_no", "support")
    )
