"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``k`` edits, ``k`` being a share of its length. It is cut
into ``k + 1`` pieces; an occurrence leaves at least one piece untouched, so exact hits of
the pieces find all places to look at. Each is verified with Myers' bit-parallel edit
distance (1999) around the hit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import append_columns

ERROR_SHARE = 0.08

#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4 << 20

LEAKS = "array<struct<item_id:bigint,distance:int,begin:bigint,end:bigint>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(item: str, share: float = ERROR_SHARE) -> int:
    return int(len(item) * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of even length with their offsets."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=64)
def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``item``; the leftmost end of
    equal ones. The whole item is one machine word, as long as it needs to be."""
    masks, m = pattern_masks(item), len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | down
        same |= (((same & up) + up) ^ up) | down
        rise = down | ~(same | up) & ones
        fall = up & same
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        # Free start: the row above the first one is 0 everywhere.
        rise = rise << 1 & ones
        fall = fall << 1 & ones
        up = fall | ~(vertical | rise) & ones
        down = rise & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Items (id, normalised text) and the automaton of their pieces."""

    def __init__(self, items: Sequence[tuple[int, str]], share: float):
        self.items = list(items)
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, budget(text, share)):
                found.setdefault(piece, []).append((at, offset))
        self.errors = [budget(text, share) for _, text in self.items]
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), tuple(places)))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def leaks(self, text: str | None) -> list[dict]:
        """The nearest occurrence of each item that is within its budget, by item."""
        if not self.any or not text:
            return []
        said = normalise(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(said):
            for at, offset in places:
                begin = last + 1 - size - offset - self.errors[at]
                end = begin + len(self.items[at][1]) + 2 * self.errors[at]
                own = spans.setdefault(at, [])
                # Hits come from left to right, so a span can only join the last ones.
                if own and begin <= own[-1][1] and begin >= own[-1][0] - self.errors[at] * 2:
                    own[-1] = (min(own[-1][0], begin), max(own[-1][1], end))
                else:
                    own.append((begin, end))
        found = []
        for at, own in spans.items():
            item_id, item = self.items[at]
            best = None
            for begin, end in own:
                begin = max(0, begin)
                distance, stop = best_end(item, said[begin:end])
                if distance <= self.errors[at] and (best is None or distance < best[0]):
                    best = (distance, begin + stop)
            if best:
                # The start, by the same search from the end backwards.
                distance, stop = best
                back = said[max(0, stop - len(item) - distance) : stop][::-1]
                _, length = anchored_end(item[::-1], back)
                found.append({"item_id": item_id, "distance": distance, "begin": stop - length, "end": stop})
        return sorted(found, key=lambda x: (x["item_id"], x["distance"], x["begin"]))


def anchored_end(item: str, text: str) -> tuple[int, int]:
    """(distance, length) of the prefix of ``text`` nearest to ``item``."""
    row = list(range(len(text) + 1))
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    best = min(row)
    return best, row.index(best)


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], share: float) -> Matcher:
    return Matcher(items, share)


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> list[tuple[tuple[int, str], ...]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash of the id.

    The driver holds one block list in all: test sets are the queries of this search, not
    its corpus, but they are still taken in blocks so that no task holds them all.
    """
    slim = items.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null")
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    blocks = []
    for block in range(n):
        rows = slim.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block).collect()
        held = sorted({(r.id, said) for r in rows if (said := normalise(r.text))}, key=lambda x: (x[0] is None, x))
        if held:
            blocks.append(tuple(held))
    return blocks


def mark_leaks(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    error_share: float = ERROR_SHARE,
    block_chars: int = BLOCK_CHARS,
    leaks: str = "leaks",
) -> DataFrame:
    """``df`` with ``leaks``: item_id, distance, begin and end of each item that occurs in
    the text within ``error_share`` of its length in edits (its nearest occurrence; offsets
    in the normalised text; the leftmost of equal ones).

    Whole texts are searched. Null and empty texts have no leaks; null and blank items are
    never found; items too short for an edit must occur exactly. Repeated rows have equal
    results, items with equal text are each reported. Empty tables give no leaks. A column
    of ``df`` named as ``leaks`` is an error.

    Row-local: nothing is shuffled, joined or broadcast but one block of items per pass.
    """
    out = df
    for number, block in enumerate(item_blocks(items, item_key, item_text, block_chars)):
        found = leaks if number == 0 else f"{leaks}_{number}"

        def search(texts: list[str | None], block=block) -> list[pa.Array]:
            matcher = _matcher(block, error_share)
            return [pa.array([matcher.leaks(t) for t in texts], _LEAKS)]

        out = append_columns(out, text, {found: LEAKS}, search)
        if number:
            out = out.withColumn(leaks, F.concat(leaks, found)).drop(found)
    return out if leaks in out.columns else out.withColumn(leaks, F.array().cast(LEAKS))


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, distance, begin, end), a row for each leak."""
    slim = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return mark_leaks(slim, items, **options).select("doc_id", F.inline("leaks"))


def drop_leaks(df: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose text has no leak, with their columns."""
    columns = df.columns
    marked = mark_leaks(df.select("*"), items, text=text, leaks="_leaks_found", **options)
    return marked.where(F.size("_leaks_found") == 0).select(*columns)
