"""The two model calls: text to vector, and prompt to entailment logits.

Only the text column goes to Python, in Arrow batches; all other columns stay in the
JVM. A model is any object with the batch method named below, given by a factory
that takes no argument; it is built once per worker process. The classes here are
deterministic stand-ins: they prove the data flow, not model quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import prompt_build, whitespace_collapse
from citeloom.functions.vectors import has_unit_norm, has_valid_size, softmax2

# Fixed value: tries per text before it is skipped.
ATTEMPTS = 3

EMBED_TYPE = "vector array<float>, attempts int, error string"
LOGITS_TYPE = "contra double, entail double, attempts int, error string"


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def logits(self, prompts: list[str]) -> np.ndarray: ...


# Slots kept by a worker, about 250 bytes each: it grows to a few megabytes with the words it
# meets, and no further. A slice asks for each of its words once.
@lru_cache(maxsize=1 << 15)
def _token_slot(token: str) -> int:
    """Slot number from the first four bytes of the digest; negative for half of the
    tokens, by the last bit of the eighth byte. Zero stands for the empty token."""
    if not token:
        return 0
    digest = hashlib.md5(token.encode()).digest()
    slot = int.from_bytes(digest[:4], "big") + 1
    return -slot if digest[7] & 1 else slot


class HashingEncoder:
    """Signed feature hashing of blank-separated words, scaled to unit length.

    A text without words, or whose words cancel out, gives a zero vector.
    """

    # Characters worked on at a time, however many texts a batch holds.
    slice_chars = 500_000

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        first, chars = 0, 0
        for row, text in enumerate(texts):
            chars += len(text)
            if chars >= self.slice_chars or row == len(texts) - 1:
                out[first : row + 1] = self._sums(texts[first : row + 1])
                first, chars = row + 1, 0
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1.0, norms)

    def _sums(self, texts: list[str]) -> np.ndarray:
        words = [text.split(" ") for text in texts]
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
        slots = np.fromiter(map(_token_slot, distinct), np.int64, len(distinct))[codes]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        cells = rows * self.size + (np.abs(slots) - 1) % self.size
        return np.bincount(cells, np.sign(slots), len(texts) * self.size).reshape(len(texts), self.size)


class OverlapScorer:
    """Logits from the share of the hypothesis' words that the premise holds."""

    def logits(self, prompts: list[str]) -> np.ndarray:
        out = np.empty((len(prompts), 2))
        for row, prompt in enumerate(prompts):
            premise, _, hypothesis = prompt.removeprefix("premise: ").partition(" hypothesis: ")
            wanted = set(hypothesis.split(" ")) - {""}
            share = len(wanted & set(premise.split(" "))) / len(wanted) if wanted else 0.0
            out[row] = (2.0 - 4.0 * share, 4.0 * share - 2.0)
        return out


def run_with_retries(call: Callable[[list[str]], np.ndarray], texts: list[str], attempts: int) -> tuple[list, list[int], list]:
    """Result row, tries and error per text.

    The batch is one try for all of it. When it fails, each text is tried on its own
    for the tries left, so that one bad text cannot take the batch with it.
    """
    try:
        return list(call(texts)), [1] * len(texts), [None] * len(texts)
    except Exception as failure:  # a model may fail in any way
        first_error = str(failure)
    rows, tries, errors = [], [], []
    for text in texts:
        row, error, used = None, first_error, 1
        while row is None and used < attempts:
            used += 1
            try:
                row, error = call([text])[0], None
            except Exception as failure:
                error = str(failure)
        rows.append(row)
        tries.append(used)
        errors.append(error)
    return rows, tries, errors


def embed_column(text: Column, make_encoder: Callable[[], Encoder] = HashingEncoder, attempts: int = ATTEMPTS) -> Column:
    """``struct<vector, attempts, error>``; ``vector`` is null when all tries failed, and for
    a null text, which costs no call."""

    @F.pandas_udf(EMBED_TYPE)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for texts in batches:
            given = texts.notna().to_numpy()
            rows, tries, errors = run_with_retries(encoder.encode, texts[given].tolist(), attempts) if given.any() else ([], [], [])
            out = pd.DataFrame({"vector": None, "attempts": 0, "error": None}, index=range(len(texts)), dtype=object)
            for column, values in (("attempts", tries), ("error", errors)):
                out.loc[given, column] = values
            vectors = iter([None if r is None else np.asarray(r, dtype=np.float32) for r in rows])
            out["vector"] = [next(vectors) if g else None for g in given]
            yield out.astype({"attempts": "int32"})

    # Non-deterministic keeps Catalyst from copying the call into several operators.
    return embed.asNondeterministic()(text)


def topic_embed(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    attempts: int = ATTEMPTS,
    keep_failures: bool = False,
) -> DataFrame:
    """Replaces ``text_col`` by ``topic_vector`` (white space collapsed first).

    Rows that fail, or whose vector is not usable, are dropped, or kept with
    ``status`` for the outcome report when ``keep_failures`` is set.
    """
    vector = F.col("_embed.vector")
    status = (
        F.when(vector.isNull(), "failed")
        .when(~(has_valid_size(vector) & has_unit_norm(vector)), "rejected")
        .otherwise("ok")
    )
    out = df.withColumn("_embed", embed_column(whitespace_collapse(F.col(text_col)), make_encoder, attempts))
    kept = [c for c in df.columns if c != text_col]
    out = out.select(*kept, vector.alias("topic_vector"), status.alias("status"), F.col("_embed.attempts").alias("attempts"))
    return out if keep_failures else out.where("status = 'ok'").drop("status", "attempts")


def support_score(
    pairs: DataFrame,
    make_scorer: Callable[[], Scorer] = OverlapScorer,
    attempts: int = ATTEMPTS,
    keep_failures: bool = False,
) -> DataFrame:
    """``contra`` and ``entail`` (they add up to 1) for rows with ``premise`` and
    ``hypothesis``. Pass distinct pairs: each row is one model call.

    A missing score must not be dropped: a pair whose tries all failed stops the job, or,
    with ``keep_failures``, stays with null scores and the last failure in ``error``."""

    @F.pandas_udf(LOGITS_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for prompts in batches:
            rows, tries, errors = run_with_retries(scorer.logits, prompts.tolist(), attempts)
            failed = [e for e in errors if e is not None]
            if failed and not keep_failures:
                raise RuntimeError(f"no score after {attempts} tries: {failed[0]}")
            logits = np.array([(None, None) if r is None else r for r in rows], dtype=np.float64).reshape(-1, 2)
            yield pd.DataFrame({"contra": logits[:, 0], "entail": logits[:, 1], "attempts": tries, "error": errors})

    prompt = prompt_build(F.col("premise"), F.col("hypothesis"))
    scored = pairs.withColumn("_logits", score.asNondeterministic()(prompt)).withColumn(
        "_soft", softmax2(F.col("_logits.contra"), F.col("_logits.entail"))
    )
    error = [F.col("_logits.error").alias("error")] if keep_failures else []
    return scored.select(*pairs.columns, "_soft.contra", "_soft.entail", *error)
