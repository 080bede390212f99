"""A corpus from raw documents to token ids, in five stages.

Each stage gets what its predecessor kept. All but the last return the columns of
``documents``; the last returns a row of digests for each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import bpe, decontaminate, ngram_join, pii, quality
from citeloom.llm.common import prepare, read_table, stage

#: Stands for the secret that a production job reads from its key store.
PII_KEY = b"a key for the test tables only"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model of the quality rules takes for good."""
    prepare(spark)
    return quality.drop_low_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, 0.8."""
    prepare(spark)
    return ngram_join.keep_one_of_each(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; their lengths stay, so ``n_chars`` stays right."""
    prepare(spark)
    return pii.pseudonymise_texts(docs, PII_KEY, counts=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to."""
    prepare(spark)
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encoding_digests(docs, vocabulary)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("pii", hide_personal_data),
    ("byte-level bpe", encode),
]

#: Edit distances, permutations and merges are not for SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
