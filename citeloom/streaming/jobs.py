"""The two endless loops as streams of files.

Claims keep no state in the stream. Ingest keeps the titles it has seen there; the
checkpoint is the position and holds that state. Each batch writes a folder of its own, named by the stream's
id and its batch id, and replaces it when the batch is repeated after a failure. The id
lives in the checkpoint, so a restarted stream keeps it, and a second stream into the same
place has another one and cannot touch what the first has written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.operators.models import Encoder, HashingEncoder, OverlapScorer, Scorer
from citeloom.operators.similarity import TOPIC_MATCHES, topk_topics
from citeloom.plans.classify import classify_claims, match_claims
from citeloom.plans.ingest import NAMES_SCHEMA, ingest_chosen, scan_reason
from citeloom.session import scratch, stage
from citeloom.sources.dump import PAGE_END, PAGES_SCHEMA, pages_from_text
from citeloom.sources.stores import TOPICS_SCHEMA, ensure_folder


#: Reads what is there and stops; pass ``{"processingTime": "1 minute"}`` for an endless stream.
ONCE = {"availableNow": True}


def _start(
    stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None
) -> StreamingQuery:

    def work(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            write_batch(batch, batch_id)

    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was new."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _answer_folder(spark: SparkSession, out: str, checkpoint: str, batch_id: int) -> str:
    return f"{out}/stream={stream_id(spark, checkpoint)}/batch={batch_id}"


def stream_claims(
    claims: DataFrame,
    topics: DataFrame,
    out: str,
    checkpoint: str,
    k: int = TOPIC_MATCHES,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Answers a stream of claims (``claim_id`` with ``text``, or with ``vector`` when
    it was embedded before) with its nearest topics, below ``out``."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        if "vector" in batch.columns:
            matches = topk_topics(stage(batch, "claims"), topics.select("topic_id", F.col("topic_vector").alias("vector")), k)
        else:
            matches = match_claims(stage(batch, "claims"), topics, k, make_encoder)
        matches.write.mode("overwrite").parquet(_answer_folder(batch.sparkSession, out, checkpoint, batch_id))

    return _start(claims, answer, checkpoint, trigger)


def stream_classify(
    claims: DataFrame,
    topics: DataFrame,
    citations: DataFrame,
    out: str,
    checkpoint: str,
    k: int = TOPIC_MATCHES,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    make_scorer: Callable[[], Scorer] = OverlapScorer,
    trigger: dict[str, Any] | None = None,
    keep_failures: bool = False,
    store: str | None = None,
) -> StreamingQuery:
    """Answers a stream of claims (``claim_id, text``) as ``classify_claims`` does: with the
    cited sentences of its nearest topics and their scores, below ``out``. With
    ``keep_failures`` one text that no score can be had for does not end the stream; with a
    ``store`` scores are kept there and shared by batches and runs."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        run = f"stream-{stream_id(batch.sparkSession, checkpoint)}-{batch_id:09d}"
        scored = classify_claims(stage(batch, "claims"), topics, citations, k, make_encoder, make_scorer, keep_failures, store, run)
        scored.write.mode("overwrite").parquet(_answer_folder(batch.sparkSession, out, checkpoint, batch_id))

    return _start(claims, answer, checkpoint, trigger)


#: A title's place in the stream's state. Each batch writes the places it touches: at ten
#: million titles some thousand share one.
TITLE_BUCKETS = 1 << 12


def first_of_title(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Names of one bucket against all titles seen in it, which are the state: the lowest
    article id of a title that is new goes on, all others get their reason. Stored names come
    with the id -1; they only enter the state."""
    seen = set(state.get[0]) if state.exists else set()
    stopped: list[tuple] = []
    copies: dict[tuple[str, int], int] = {}
    paths: dict[tuple[str, int], str] = {}
    for batch in batches:
        for title, article, path, reason, stored in zip(*(batch[c].tolist() for c in ("title", "article_id", "path", "reason", "stored")), strict=True):
            if reason is not None:
                stopped.append((title, article, path, reason, 1))
            elif stored:
                seen.add(title)
            else:
                copies[title, article] = copies.get((title, article), 0) + 1
                paths[title, article] = min(path, paths.get((title, article), path))
    asked, before = [], None
    for title, article in sorted(copies):
        reason = "present" if title in seen else "title repeated" if title == before else None
        asked.append((title, article, paths[title, article], reason, copies[title, article]))
        before = title
    seen.update(title for title, _ in copies)
    state.update((sorted(seen),))
    yield pd.DataFrame(asked + stopped, columns=["title", "article_id", "path", "reason", "copies"]).astype({"article_id": "int64", "copies": "int64"})


def new_names(raw_pages: DataFrame, store: str, buckets: int = TITLE_BUCKETS) -> DataFrame:
    """A stream of ``NAMES_SCHEMA`` rows for a stream of page files. Only names go through the
    shuffle and into the state. The names that the store has come as a second source of the
    stream: all of them in its first batch, later those of files that runs, also others',
    have added since."""
    spark = raw_pages.sparkSession
    pages = pages_from_text(raw_pages.select("value", F.col("_metadata.file_path").alias("path")), ["path"])
    judged = pages.select("title", "article_id", "path", scan_reason().alias("reason"))
    ensure_folder(spark, f"{store}/topics")
    topics = spark.readStream.schema(TOPICS_SCHEMA).option("ignoreMissingFiles", "true").parquet(f"{store}/topics")
    known = topics.select(
        F.col("name").alias("title"),
        F.lit(-1).cast("bigint").alias("article_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(True).alias("stored"),
    )
    # Numbers stay whole in pandas only without nulls.
    asked = judged.select("title", F.coalesce("article_id", F.lit(-1)).alias("article_id"), "path", "reason", F.lit(False).alias("stored"))
    place = F.pmod(F.xxhash64(F.coalesce("title", F.col("article_id").cast("string"))), F.lit(buckets))
    keyed = asked.unionByName(known).select("*", F.lit(1).cast("bigint").alias("copies"), place.alias("bucket"))
    chosen = keyed.groupBy("bucket").applyInPandasWithState(first_of_title, NAMES_SCHEMA, "titles array<string>", "append", GroupStateTimeout.NoTimeout)
    return chosen.withColumn("article_id", F.nullif("article_id", F.lit(-1).cast("bigint")))


def stream_ingest(
    raw_pages: DataFrame,
    store: str,
    checkpoint: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Ingests dump files as they arrive. ``raw_pages`` is a text stream of files cut at the
    end tag of each page (option ``lineSep``). Pages that are stored are skipped.

    Which titles are known is the stream's state, kept in its checkpoint: the stored tables are
    read as a source that only gives what is new, and never scanned by a batch. Ids are
    reserved (``sources.register``), so streams may run side by side. A batch's texts are read
    from its files again, for the names that the state lets through.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = stage(batch, "names")
        paths = [r.path for r in names.where("reason is null").select("path").distinct().collect()]
        if not paths and names.isEmpty():
            return
        pages = pages_from_text(spark.read.option("lineSep", PAGE_END).text(paths)) if paths else spark.createDataFrame([], PAGES_SCHEMA)
        run = f"stream-{stream_id(spark, checkpoint)}-{batch_id:09d}"
        ingest_chosen(pages, names, store, run, make_encoder)

    return _start(new_names(raw_pages, store), ingest, checkpoint, trigger)
