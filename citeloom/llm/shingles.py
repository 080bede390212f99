"""Sets of word shingles as sorted arrays of 64-bit hashes, computed in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)

# Lower case for A-Z; the six white-space bytes become one.
_FOLD = bytes(32 if b in b" \t\n\r\x0b\f" else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes hashed at a time, in arrays of eight bytes for each; a longer stretch without white
#: space is hashed alone.
BLOCK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1024), _powers(_UNBASE, 1024)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_UNBASE, n)
    return _UP, _DOWN


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded bytes, and where each starts."""
    data = np.frombuffer(raw, np.uint8)
    word = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _grown(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased."""
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            hashes, starts = _hash_words(b" ".join(raw for _, raw in held))
            ends = np.cumsum([len(raw) + 1 for _, raw in held])
            for (i, _), part in zip(held, np.split(hashes, np.searchsorted(starts, ends)[:-1]), strict=True):
                out[i] = part
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        raw = (text or "").encode().translate(_FOLD)
        if len(raw) > BLOCK:
            parts, at = [], 0
            while at < len(raw):
                cut = raw.rfind(b" ", at, at + BLOCK) if at + BLOCK < len(raw) else len(raw)
                if cut <= at:
                    cut = raw.find(b" ", at + BLOCK)
                cut = len(raw) if cut < 0 else cut
                parts.append(_hash_words(raw[at:cut])[0])
                at = cut + 1
            out[i] = np.concatenate(parts)
            continue
        held.append((i, raw))
        size += len(raw)
        if size >= BLOCK:
            flush()
    flush()
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of ``width`` words, sorted; with fewer words all of them as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACES[k]
    return np.unique(mix(total))


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    return [shingle_set(w, width) for w in word_hashes(texts)]
