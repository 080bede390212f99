"""Checked queries: vectors, similarity, model calls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from citeloom.checks.inputs import embedding_sql
from citeloom.checks.registry import query
from citeloom.functions.vectors import (
    dot_product,
    l2_norm,
    score_parse,
    score_shape_ok,
    softmax2,
    vector_parse,
    vector_to_float,
)
from citeloom.operators.models import HashingEncoder, topic_embed
from citeloom.operators.pivots import group_topics, grouped_topk
from citeloom.operators.similarity import (
    TOPIC_MATCHES,
    claim_topic_sim,
    dim_check,
    slot_present,
    topk_topics,
    unit_norm_check,
)
from citeloom.session import stage

VECTOR_TEXT_SQL = """texts AS (
  SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ' ' || chr(10) || '  ') || ']' AS text
  FROM embeddings
)"""


def vector_texts(t):
    numbers = F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double")))
    return t.embeddings.select("vec_id", F.concat(F.lit("["), F.array_join(numbers, " \n  "), F.lit("]")).alias("text"))


@query(
    "vector_parse",
    f"WITH {VECTOR_TEXT_SQL}, w AS (SELECT vec_id, list_filter(string_split(regexp_replace(text, '[\\[\\]\\r\\n]', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM texts) "
    "SELECT vec_id, i - 1 AS pos, l[i]::DOUBLE AS value FROM (SELECT vec_id, l, unnest(range(1, len(l) + 1)) AS i FROM w)",
)
def _(t):
    rows = vector_texts(t).select("vec_id", F.posexplode(vector_parse(F.col("text"))).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("vector_to_float", "SELECT vec_id, round(sum(x), 6) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def _(t):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    floats = t.embeddings.select("vec_id", F.explode(vector_to_float(doubles)).alias("x"))
    return floats.groupBy("vec_id").agg(F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))


# One score line per document; some lines have one part, three parts, or no number.
SCORE_TEXT_SQL = """lines AS (
  SELECT doc_id, CASE lang WHEN 'de' THEN '[' || n_chars || ']' WHEN 'fr' THEN '[ ' || n_chars || ' ' || doc_id || ']'
    WHEN 'es' THEN NULL ELSE '[' || n_chars || '.5  ' || doc_id || '.25]' END AS text FROM documents
)"""


def score_texts(t):
    text = (
        F.when(F.col("lang") == "de", F.concat(F.lit("["), "n_chars", F.lit("]")))
        .when(F.col("lang") == "fr", F.concat(F.lit("[ "), "n_chars", F.lit(" "), "doc_id", F.lit("]")))
        .when(F.col("lang") == "es", F.lit(None))
        .otherwise(F.concat(F.lit("["), "n_chars", F.lit(".5  "), "doc_id", F.lit(".25]")))
    )
    return t.documents.select("doc_id", text.alias("text"))


@query(
    "score_parse",
    f"WITH {SCORE_TEXT_SQL} SELECT l.doc_id, n_chars + 0.5::DOUBLE AS contra, l.doc_id + 0.25::DOUBLE AS entail "
    "FROM lines l JOIN documents d USING (doc_id) WHERE lang NOT IN ('de', 'fr', 'es')",
)
def _(t):
    parsed = score_texts(t).select("doc_id", score_parse(F.col("text")).alias("s"))
    return parsed.where("s is not null").select("doc_id", "s.contra", "s.entail")


@query(
    "score_shape_check",
    f"WITH {SCORE_TEXT_SQL} SELECT doc_id FROM lines WHERE coalesce(len(list_filter(string_split(text, ' '), lambda x: x <> '')), 0) <> 2",
)
def _(t):
    return score_texts(t).where(~score_shape_ok(F.col("text"))).select("doc_id")


@query(
    "softmax2",
    """WITH l AS (SELECT doc_id, ln(1 + n_chars) - 7 AS c, (doc_id % 1000) / 100.0 - 5 AS e FROM documents)
SELECT doc_id, round(exp(c) / (exp(c) + exp(e)), 6) AS contra, round(exp(e) / (exp(c) + exp(e)), 6) AS entail FROM l""",
)
def _(t):
    soft = softmax2(F.log1p("n_chars") - 7, F.pmod("doc_id", F.lit(1000)) / 100.0 - 5)
    return t.documents.select("doc_id", soft.alias("s")).select("doc_id", F.round("s.contra", 6).alias("contra"), F.round("s.entail", 6).alias("entail"))


@query("l2_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"))


@query(
    "dot_product",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select("vec_id", F.round(dot_product(F.col("embedding"), F.col("other")), 6).alias("sim"))


# Vectors made bad on purpose: scaled by label, one number short, or missing.
STRETCHED_SQL = """SELECT vec_id AS topic_id, CASE label % 4 WHEN 0 THEN embedding
  WHEN 1 THEN list_transform(embedding, lambda x: (x * 1.005)::FLOAT) WHEN 2 THEN list_transform(embedding, lambda x: (x * 1.02)::FLOAT)
  END AS topic_vector FROM embeddings"""


def stretched(t):
    shape = F.pmod("label", F.lit(4))
    vector = (
        F.when(shape == 0, F.col("embedding"))
        .when(shape == 1, F.transform("embedding", lambda x: (x * 1.005).cast("float")))
        .when(shape == 2, F.transform("embedding", lambda x: (x * 1.02).cast("float")))
    )
    return t.embeddings.select(F.col("vec_id").alias("topic_id"), vector.alias("topic_vector"))


@query(
    "unit_norm_check",
    f"WITH s AS ({STRETCHED_SQL}) SELECT topic_id FROM s WHERE abs(sqrt(list_sum(list_transform(topic_vector, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.01",
)
def _(t):
    return unit_norm_check(stretched(t)).select("topic_id")


@query("slot_present", f"WITH s AS ({STRETCHED_SQL}) SELECT topic_id, len(topic_vector) AS size FROM s WHERE topic_vector IS NOT NULL")
def _(t):
    return slot_present(stretched(t)).select("topic_id", F.size("topic_vector").cast("bigint").alias("size"))


@query("dim_check", "SELECT vec_id AS topic_id FROM embeddings WHERE (len(embedding) - label % 3) % 8 <> 0")
def _(t):
    shorter = F.slice("embedding", F.lit(1), F.size("embedding") - F.pmod("label", F.lit(3)))
    return dim_check(t.embeddings.select(F.col("vec_id").alias("topic_id"), shorter.alias("topic_vector"))).select("topic_id")


# --- similarity: every vector is a claim against all topics -----------------


def claims_of(t):
    return t.embeddings.select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector"))


def topics_of(t):
    return t.embeddings.select(F.col("vec_id").alias("topic_id"), F.col("embedding").alias("vector"))


SIMS_SQL = """sims AS (
  SELECT c.vec_id AS claim_id, t.vec_id AS topic_id,
         round(list_dot_product(c.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings c CROSS JOIN embeddings t
)"""

TOPK_SQL = f"""{SIMS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY sim DESC, topic_id) AS rank FROM sims WHERE sim > 0
), matches AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query(
    "claim_topic_sim",
    f"WITH {SIMS_SQL} SELECT claim_id, count(*) AS n_topics, round(sum(sim), 5) AS sim_sum, round(max(sim), 6) AS sim_max FROM sims GROUP BY claim_id",
)
def _(t):
    s = claim_topic_sim(claims_of(t), topics_of(t))
    return s.select("claim_id", "n_topics", F.round("sim_sum", 5).alias("sim_sum"), F.round("sim_max", 6).alias("sim_max"))


@query("positive_sim", f"WITH {SIMS_SQL} SELECT claim_id, count(*) AS n_positive FROM sims WHERE sim > 0 GROUP BY claim_id")
def _(t):
    return claim_topic_sim(claims_of(t), topics_of(t)).where("n_positive > 0").select("claim_id", "n_positive")


@query("claim_topic_sim_grid", f"WITH {SIMS_SQL} SELECT claim_id, count(*) AS n_topics, count(*) FILTER (sim > 0) AS n_positive, round(max(sim), 6) AS sim_max FROM sims GROUP BY claim_id")
def _(t):
    """The way of more claims than can be broadcast: cells of both sides."""
    s = claim_topic_sim(stage(claims_of(t), "claims"), stage(topics_of(t), "topics"), broadcast_bytes=10_000)
    return s.select("claim_id", "n_topics", "n_positive", F.round("sim_max", 6).alias("sim_max"))


@query("topk_topics", f"WITH {TOPK_SQL} SELECT claim_id, topic_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM matches")
def _(t):
    return topk_topics(claims_of(t), topics_of(t)).withColumn("sim", F.round("sim", 6))


GROUPED_SQL = f"WITH {TOPK_SQL} SELECT claim_id, topic_id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM matches"


@query("topk_topics_grouped", GROUPED_SQL)
def _(t):
    """The way of many claims, whatever their number: groups of topics and bounds."""
    groups = group_topics(topics_of(t))
    return grouped_topk(claims_of(t), groups, TOPIC_MATCHES).matches.withColumn("sim", F.round("sim", 6))


# --- models -----------------------------------------------------------------


@query("topic_embed", f"WITH {embedding_sql('documents', 'doc_id', 'text')} SELECT doc_id, bucket, round(value::DOUBLE, 6) AS value FROM documents_parts")
def _(t):
    vectors = topic_embed(t.documents.select("doc_id", "text"), "text")
    parts = vectors.select("doc_id", F.posexplode("topic_vector").alias("bucket", "value")).where("value <> 0")
    return parts.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value"))


class MoodyEncoder(HashingEncoder):
    """Fails on any batch that holds a text with ``@``, every time."""

    def encode(self, texts: list[str]) -> np.ndarray:
        if any("@" in text for text in texts):
            raise ValueError("will not read this")
        return super().encode(texts)


@query(
    "retry_then_skip",
    f"""WITH {embedding_sql('documents', 'doc_id', 'text')}, usable AS (SELECT DISTINCT doc_id FROM documents_parts)
SELECT d.doc_id, CASE WHEN contains(text, '@') THEN 'failed' WHEN u.doc_id IS NULL THEN 'rejected' ELSE 'ok' END AS status
FROM documents d LEFT JOIN usable u USING (doc_id)""",
)
def _(t):
    return topic_embed(t.documents.select("doc_id", "text"), "text", MoodyEncoder, keep_failures=True).select("doc_id", "status")
