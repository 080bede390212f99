"""Language identification with a small convolutional network over bytes.

Filters of several widths run over embedded bytes of a window of fixed length, the
maximum of each filter over the window goes into a softmax. The network is trained in
numpy on a bounded sample of labelled texts and applied to all windows of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import append_columns

WINDOW = 256
WIDTHS = (2, 3, 5)
FILTERS = 24
EMBEDDING = 8

#: Bound of the training sample: texts in all, and windows from each.
SAMPLE_TEXTS = 2400
SAMPLE_WINDOWS = 3

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray
    widths: tuple[int, ...] = field(default=WIDTHS)

    @staticmethod
    def new(languages: Sequence[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)

        def small(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        embed = small(256, EMBEDDING) * 16
        embed[0] = 0  # padding
        return ByteNet(
            list(languages), embed, [small(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            small(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32),
        )

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window, and for training its place."""
        x = self.embed[windows]
        best, places = [], []
        for width, weight, bias in zip(self.widths, self.filters, self.biases, strict=True):
            y = patches(x, width) @ weight
            places.append(y.argmax(1))
            best.append(np.take_along_axis(y, places[-1][:, None], 1)[:, 0] + bias)
        return np.maximum(np.concatenate(best, 1), 0), places

    def probabilities(self, windows: np.ndarray, each: int = 128) -> np.ndarray:
        out = []
        for part in (windows[i : i + each] for i in range(0, len(windows), each)):
            x = self.embed[part]
            best = [(patches(x, w) @ f).max(1) + b for w, f, b in zip(self.widths, self.filters, self.biases, strict=True)]
            out.append(softmax(np.maximum(np.concatenate(best, 1), 0) @ self.dense + self.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def patches(x: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * embedding) of (windows, bytes, embedding)."""
    n, length, size = x.shape
    return as_strided(x, (n, length - width + 1, width * size), x.strides[:2] + (x.itemsize,)).copy()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_windows(texts: Sequence[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of lower-cased texts, padded with zeros, and how many each text has."""
    raw = [t.lower().encode() for t in texts]
    counts = np.array([max(1, -(-len(r) // window)) for r in raw], np.int64)
    flat = b"".join(r.ljust(c * window, b"\0") for r, c in zip(raw, counts.tolist(), strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, window), counts


def train(texts: Sequence[str], labels: Sequence[str], epochs: int = 12, batch: int = 64, rate: float = 0.003, seed: int = 7) -> ByteNet | None:
    """Adam on cross-entropy; the gradient of a maximum goes to its place alone."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net = ByteNet.new(languages, seed)
    windows, counts = text_windows(texts)
    wanted = np.repeat([languages.index(x) for x in labels], counts)
    enough = np.count_nonzero(windows, axis=1) >= min(32, WINDOW)
    if enough.any():
        windows, wanted = windows[enough], wanted[enough]
    rng = np.random.default_rng(seed)
    values = [net.embed, *net.filters, *net.biases, net.dense, net.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for some in (order[i : i + batch] for i in range(0, len(order), batch)):
            grads = gradients(net, windows[some], wanted[some])
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    return net


def gradients(net: ByteNet, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    hidden, places = net.pooled(windows)
    error = softmax(hidden @ net.dense + net.bias)
    error[np.arange(len(wanted)), wanted] -= 1
    error /= len(wanted)
    back = (error @ net.dense.T) * (hidden > 0)
    embed, filters, biases = np.zeros_like(net.embed), [], []
    for k, (width, weight, place) in enumerate(zip(net.widths, net.filters, places, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        taken = windows[np.arange(len(windows))[:, None, None], place[:, :, None] + np.arange(width)]
        patch = net.embed[taken].reshape(*place.shape, -1)
        filters.append(np.einsum("nf,nfp->pf", g, patch))
        biases.append(g.sum(0))
        onto = (g[:, :, None] * weight.T[None]).reshape(*place.shape, width, EMBEDDING)
        np.add.at(embed, taken, onto)
    return [embed, *filters, *biases, hidden.T @ error, error.sum(0)]


def fold(key: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(folds))


def training_sample(df: DataFrame, key: str, text: str, lang: str, texts: int, windows: int) -> tuple[list[str], list[str]]:
    """Texts and labels of at most about ``texts`` rows, an equal share for each label.

    A row is taken by a hash of its id and text, the same ones every time. Of each, up to
    ``windows`` stretches of one window are read, at places spread over the text.
    """
    rows = df.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(texts).collect()}
    each = max(1, texts // max(1, len(counts)))
    lot = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(lang) == label, min(1.0, each / n)).otherwise(share)
    room = F.greatest(F.length(text) - WINDOW, F.lit(0))
    parts = [F.substring(F.col(text), (room * (i / max(1, windows - 1))).cast("int") + 1, F.lit(WINDOW)) for i in range(windows)]
    taken = rows.where(lot < share).select(F.col(lang), lot, F.array_distinct(F.array(*parts))).collect()
    found = sorted((r[0], r[1], s) for r in taken for s in r[2])
    return [s for *_, s in found], [label for label, *_ in found]


def predict_language(df: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score of every whole text.

    A text's windows are averaged by their number of bytes; ``score`` is the average of
    the language with the largest one (the first by name of equal ones). ``und`` with 0 if
    the text is null or has no letter, or if there was nothing to learn from. Row-local;
    an empty table stays empty; a column named lang_pred or score is an error.
    """

    def predict(texts: list[str | None]) -> list[pa.Array]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for some in near_sized([i for i, t in enumerate(texts) if net and t and _LETTER.search(t)], texts):
            windows, counts = text_windows([texts[i] for i in some])
            weights = np.maximum(np.count_nonzero(windows, axis=1), 1)[:, None]
            ends = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(net.probabilities(windows) * weights, ends) / np.add.reduceat(weights, ends)
            for i, row in zip(some, mean, strict=True):
                names[i], scores[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(df, text, {"lang_pred": "string", "score": "double"}, predict)


def near_sized(rows: list[int], texts: list[str | None], most: int = 4 << 20) -> list[list[int]]:
    """Rows in groups of about ``most`` characters."""
    groups, size = [], most
    for i in rows:
        if size >= most:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(texts[i])
    return groups


def learn_and_predict(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The network learns from labelled rows outside the
    held-out fold; label and id are no inputs of a prediction."""
    slim = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held_out = fold(F.col("doc_id")) == held_out_fold
    net = train(*training_sample(slim.where(~held_out), "doc_id", "text", "lang", SAMPLE_TEXTS, SAMPLE_WINDOWS))
    return predict_language(slim.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")
