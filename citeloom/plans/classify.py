"""Claims to matched topics, their citations, and scored support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.models import Encoder, HashingEncoder, OverlapScorer, Scorer, topic_embed
from citeloom.operators.similarity import TOPIC_MATCHES, topk_topics
from citeloom.operators.support import (
    claim_premise_pairs,
    prune_to_topics,
    score_pairs,
    split_claims,
    topic_citations,
)
from citeloom.session import stage


def match_claims(
    claims: DataFrame, topics: DataFrame, k: int = TOPIC_MATCHES, make_encoder: Callable[[], Encoder] = HashingEncoder
) -> DataFrame:
    """Nearest topics of ``claim_id, text`` rows. Claims without a usable vector or
    without a topic of positive similarity get no row."""
    vectors = topic_embed(claims.select("claim_id", "text"), "text", make_encoder)
    staged = stage(vectors.withColumnRenamed("topic_vector", "vector"), "claims")
    return topk_topics(staged, topics.select("topic_id", F.col("topic_vector").alias("vector")), k)


def classify_claims(
    claims: DataFrame,
    topics: DataFrame,
    citations: DataFrame,
    k: int = TOPIC_MATCHES,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    make_scorer: Callable[[], Scorer] = OverlapScorer,
    keep_failures: bool = False,
    store: str | None = None,
    run: str | None = None,
) -> DataFrame:
    """``claim_id, line_no, topic_id, sim, rank, name, citation_id, uri, sentence,
    contra, entail``; ``operators.support.support_nested`` makes lists of it.

    A pair that cannot be scored ends the job. With ``keep_failures`` it is a row with null
    scores and the reason in a further column ``error``, null for all others. With a ``store``
    text pairs that earlier runs have scored cost no call of the model.

    Matches and pairs are staged: each is read several times after.
    """
    matches = stage(match_claims(claims, topics, k, make_encoder), "matches")
    cited = topic_citations(matches, topics, prune_to_topics(citations, matches))
    pairs = stage(claim_premise_pairs(split_claims(claims), cited), "pairs")
    error = ["error"] if keep_failures else []
    return score_pairs(pairs, make_scorer, keep_failures, store, run).select(
        "claim_id", "line_no", "topic_id", "sim", "rank", "name", "citation_id", "uri", "sentence", "contra", "entail", *error
    )
