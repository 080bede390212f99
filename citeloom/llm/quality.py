"""Quality by weak supervision.

Rules look at counts of a text and vote good, vote bad or abstain. How far each vote can
be trusted is not set by hand: expectation-maximisation (Dawid and Skene, 1979) estimates
it from how the rules agree over all documents. The posterior probability of quality
decides, instead of a demand that every rule passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import stage


SPACE = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_letters", "n_upper", "n_letter_words", "n_ends", "n_shouts",
)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which characters of the basic plane are letters, and which upper-case letters."""
    plane = [chr(c) for c in range(0x10000)]
    return np.array([c.isalpha() for c in plane]), np.array([c.isupper() for c in plane])


def _classes() -> bytes:
    """Bytes as: blank, 'a' for letters and all of other scripts, '.' for sentence ends, ','."""
    out = bytearray(b"," * 256)
    for b in range(256):
        if b in SPACE:
            out[b] = ord(" ")
        elif b >= 0x80 or chr(b).isalpha():
            out[b] = ord("a")
        elif chr(b) in ".!?":
            out[b] = ord(".")
    return bytes(out)


CLASSES = _classes()


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice."""
    places = len(ids) - window + 1
    if places < 2:
        return 0
    ids = ids.astype(np.int64)
    code, span = ids[:places], distinct
    for k in range(1, window):
        if span > (1 << 62) // max(distinct, 1):  # the code would overflow: number the codes anew
            values, code = np.unique(code, return_inverse=True)
            span = len(values)
        code, span = code * distinct + ids[k : k + places], span * distinct
    _, where, times = np.unique(code, return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, np.int64)
    repeated = np.flatnonzero(times[where] > 1)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one whole text; zeros for null.

    Words are runs of bytes other than space and 0x09-0x0D; lines are split at line feeds.
    """
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    points = points[points < 0x10000]
    letter, upper = _letters()
    kinds = raw.translate(CLASSES)
    blanks = len(raw) - len(raw.translate(None, SPACE))
    return (
        len(words),
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(number)),
        len(lines),
        len(number),
        int(np.count_nonzero(letter[points])),
        int(np.count_nonzero(upper[points])),
        sum(b"a" in w for w in kinds.split()),
        kinds.count(b". ") + kinds.endswith(b"."),
        raw.count(b"!"),
    )


def with_counts(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and the counts of ``text``."""
    slim = df.select(*keep, F.col(text).alias("_text"))
    schema = slim.drop("_text")
    for name in COUNTS:
        schema = schema.withColumn(f"_{name}", F.lit(0).cast("bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([count_text(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c) for c in counts.T]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f"_{c}" for c in COUNTS]])

    return slim.mapInArrow(count, schema.schema)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("tinyint")


#: Over the counts, written as parts of the number of words so that short texts have no division.
RULES = (
    Rule("symbols", "10 * _n_symbols > _n_words", "_n_symbols = 0 and _n_words >= 20"),
    Rule("letters", "5 * _n_letters < 4 * _word_chars", "10 * _n_letters > 9 * _word_chars and _n_words >= 20"),
    Rule("repeats", "100 * _n_repeat_words > 20 * _n_words", "100 * _n_repeat_words <= 5 * _n_words and _n_words >= 20"),
    Rule("dup_lines", "10 * _n_dup_lines > 3 * _n_lines", "_n_dup_lines = 0 and _n_lines >= 3"),
    Rule("distinct", "10 * _n_distinct < 3 * _n_words and _n_words < 5000", "2 * _n_distinct > _n_words and _n_words >= 20"),
    Rule("upper", "10 * _n_upper > 3 * _n_letters and _n_words >= 10", "20 * _n_upper < _n_letters"),
    Rule("shouts", "5 * _n_shouts > _n_words", "false"),
    Rule("letter_words", "10 * _n_letter_words < 7 * _n_words", "20 * _n_letter_words > 19 * _n_words"),
    Rule("word_length", "_word_chars < 2 * _n_words or _word_chars > 12 * _n_words", "_word_chars > 3 * _n_words and _word_chars < 10 * _n_words"),
    Rule("sentences", "100 * _n_ends < _n_words and _n_words >= 50", "50 * _n_ends > _n_words and 3 * _n_ends < _n_words"),
)

BASE_FAILED = "_n_words < 10 or 100 * _n_repeat_words > 20 * _n_words"


@dataclass(frozen=True)
class LabelModel:
    """Log-odds of quality: a constant, and for each rule what its votes -1, 0, 1 add."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: Sequence[Column]) -> Column:
        odds = F.lit(self.prior)
        for vote, (bad, none, good) in zip(votes, self.weights, strict=True):
            odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their counts.

    Starts from the number of bad votes (none, one, more), which fixes the meaning of the
    two classes. A rule that abstains says nothing: its votes are modelled
    given that it votes, so texts too short for most rules are not marked down. One pseudo-count per vote and class keeps the estimates
    off 0 and 1. Without any documents all weights are 0.
    """
    rules = patterns.shape[1] if patterns.ndim == 2 else 0
    if not len(patterns):
        return LabelModel(0.0, ((0.0, 0.0, 0.0),) * rules)
    total = counts.sum()
    good = np.array([0.95, 0.3, 0.05])[np.minimum((patterns < 0).sum(1), 2)]
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight.sum(1) + 1) / (total + 2)
        seen = np.stack([[(weight * (patterns[:, j] == v)).sum(1) + 1 for v in (-1, 1)] for j in range(rules)])
        chance = np.log(seen / seen.sum(1, keepdims=True))
        ratio = np.insert(chance[:, :, 1] - chance[:, :, 0], 1, 0.0, axis=1)
        odds = math.log(share[1] / share[0]) + ratio[np.arange(rules), patterns + 1].sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return LabelModel(math.log(share[1] / share[0]), tuple(tuple(map(float, r)) for r in ratio))


def judge_quality(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES
) -> tuple[DataFrame, LabelModel]:
    """Columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, p_good, kept; and the model.

    ``kept`` is false for texts below the base rules (under 10 words, or more than a fifth
    of the words in repeated windows of five), else ``p_good >= 0.5``. A null text has no
    words. Rows are judged one by one, so repeated rows have equal results; an empty table
    gives an empty one. A column of ``keep`` must not have the name of a result column.

    Texts are read once; the counts, with ``keep``, are staged. What reaches the driver is
    the number of documents for each pattern of votes, at most 3 to the number of rules.
    """
    counted = stage(with_counts(df, text, keep), "counts")
    votes = [r.vote().alias(f"_vote_{r.name}") for r in rules]
    names = [f"_vote_{r.name}" for r in rules]
    seen = counted.where(f"not ({BASE_FAILED})").select(*votes).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([r[:-1] for r in seen], np.int64).reshape(-1, len(rules))
    model = fit_label_model(patterns, np.array([r.n for r in seen], np.float64))
    judged = counted.select("*", *votes).withColumn("_base_failed", F.expr(BASE_FAILED)).withColumn("_p", model.posterior([F.col(n) for n in names]))
    return (
        judged.select(
            *keep,
            *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]],
            F.col("_base_failed").alias("base_failed"),
            F.col("_p").alias("p_good"),
            (~F.col("_base_failed") & (F.col("_p") >= 0.5)).alias("kept"),
        ),
        model,
    )


def drop_low_quality(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that ``judge_quality`` keeps, with their columns, whatever their
    names."""
    rows = df.select(F.struct("*").alias("_row"), F.col(text).alias("_said"))
    judged, _ = judge_quality(rows, "_said", ["_row"], rules)
    return judged.where("kept").select("_row.*")
