"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary is an acceptor. Composed with a transducer that replaces or inserts one
letter, and with the acceptor again, it accepts the pairs of near words. The work is
dealt out by initial state. A pair agrees up to its edit, and behind it again: with the
length m of the shorter word and the place l of the edit in [lo, hi), both words share the
first lo letters and the last m - hi. These name the state that a path starts from and the
one it ends in, and so a partition; the residual words between the two are minimised into
an acceptor and composed there. Every pair has one place and comes from one partition.

A partition with too many words is cut again at half its range of places, down to a single
place: there its size is bounded by the alphabet, whatever the vocabulary's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import batches_of, rows_of, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a partition before it is cut again.
MOST_WORDS = 10_000

PLACE = ["m", "lo", "hi", "head", "tail"]


class Acceptors:
    """Minimised acyclic acceptors that share their states, and what is composed of them.

    A state is the number of its transitions (letter, state) in order; state 0 is final and
    has none. All words of one acceptor have the same length, so no other state is final.
    """

    def __init__(self):
        self.states: list[tuple[tuple[str, int], ...]] = [()]
        self.known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {(0, 0): [""]}
        self._replaced: dict[int, list[tuple[str, str]]] = {0: []}
        self._inserted: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def add(self, words: list[str]) -> int | None:
        """The initial state of an acceptor of different words of one length, in order."""
        if not words:
            return None
        return self._state(words, 0, len(words), 0, len(words[0]))

    def _state(self, words: list[str], begin: int, end: int, depth: int, length: int) -> int:
        if depth == length:
            return 0
        moves = []
        while begin < end:
            letter, stop = words[begin][depth], begin + 1
            while stop < end and words[stop][depth] == letter:
                stop += 1
            moves.append((letter, self._state(words, begin, stop, depth + 1, length)))
            begin = stop
        found = tuple(moves)
        if found not in self.known:
            self.known[found] = len(self.states)
            self.states.append(found)
        return self.known[found]

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        at = (p, q) if p <= q else (q, p)
        if at not in self._common:
            if p == q:
                self._common[at] = [c + rest for c, s in self.states[p] for rest in self.common(s, s)]
            else:
                other = dict(self.states[q])
                self._common[at] = [c + rest for c, s in self.states[p] if c in other for rest in self.common(s, other[c])]
        return self._common[at]

    def replaced(self, p: int) -> list[tuple[str, str]]:
        """Pairs of accepted words that differ in one letter, the lower word first."""
        if p not in self._replaced:
            moves = self.states[p]
            found = [(c + x, c + y) for c, s in moves for x, y in self.replaced(s)]
            found += [(c + rest, d + rest) for (c, s), (d, t) in combinations(moves, 2) for rest in self.common(s, t)]
            self._replaced[p] = found
        return self._replaced[p]

    def inserted(self, p: int, q: int, at_end: bool) -> list[tuple[str, str]]:
        """Pairs of a word of ``p`` and one of ``q`` with one letter more. In a run of equal
        letters the last one counts as the new one; ``at_end`` says whether it may stand
        behind the whole word."""
        if (p, q) not in self._inserted:
            longer, found = dict(self.states[q]), []
            for c, s in self.states[p]:
                if c in longer:
                    found += [(c + x, c + y) for x, y in self.inserted(s, longer[c], at_end)]
            for d, t in longer.items():
                if p or at_end:
                    found += [(rest, d + rest) for rest in self.common(p, t) if rest[:1] != d]
            self._inserted[p, q] = found
        return self._inserted[p, q]


def near_pairs(m: int, lo: int, hi: int, head: str, tail: str, words: Iterable[str]) -> Iterator[tuple[str, str]]:
    """The near pairs of one partition: words of length m with each other and with those of
    m + 1. Repeats among ``words`` count once."""
    words = sorted(set(words))
    begin, behind = len(head), len(tail)
    short = [w[begin : m - behind] for w in words if len(w) == m]
    long = [w[begin : m + 1 - behind] for w in words if len(w) == m + 1]
    automata = Acceptors()
    first, second = automata.add(short), automata.add(long)
    if first is None:
        return
    pairs = list(automata.replaced(first))
    if second is not None:
        pairs += automata.inserted(first, second, hi > m)
    for x, y in pairs:
        yield head + x + tail, head + y + tail


def typed(word: Column, key: Column, every: int) -> Column:
    """``word`` with one letter left out where ``every`` divides the checksum of ``key:word``:
    slips of the pen that are the same in every run."""
    sign = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (sign % F.length(word)).cast("int")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(sign % every == 0, cut).otherwise(word)


def word_counts(df: DataFrame, pattern: str, text: str = "text", key: str = "doc_id", slips: int | None = None, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): matches of ``pattern`` in the whole texts, A-Z lower-cased, that have
    ``min_chars`` and occur ``min_count`` times. Counts are partial per task, so that a very
    common word is one row of a task. Null texts have none, a null key counts as empty,
    repeated rows count as often as they occur."""
    said = F.translate(F.col(text), UPPER, LOWER)
    words = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(said, F.lit(pattern), F.lit(0))).alias("word"))
    if slips is not None:
        words = words.select(typed(F.col("word"), F.col("key"), slips).alias("word"))
    long = words.where(F.length("word") >= min_chars)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _placed(words: DataFrame, ranges: Column) -> DataFrame:
    """Words once per entry (m, lo, hi) of ``ranges``, with the shared letters of each."""
    rows = words.select("word", "n", F.inline(ranges))
    last = F.col("m") - F.least("hi", "m")
    return rows.select(
        "word", "n", "m", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")).alias("head"), F.when(last > 0, F.right("word", last)).otherwise("").alias("tail")
    )


def _range(m: Column, lo: Column, hi: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def partitions(vocabulary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, n, m, lo, hi, head, tail): each word in every partition where it may find a near
    one. No partition has more than ``most_words`` words unless its range is one place."""
    length = F.length("word")
    halves = [F.array(_range(m, F.lit(0), F.floor(m / 2)), _range(m, F.floor(m / 2), m + 1)) for m in (length, length - 1)]
    rows = _placed(vocabulary, F.concat(*halves)).where("lo < hi and m > 0")
    settled: list[DataFrame] = []
    while True:
        large = stage(rows.groupBy(*PLACE).count().where((F.col("count") > most_words) & (F.col("hi") - F.col("lo") > 1)).select(*PLACE), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, settled, rows)
        settled.append(rows.join(large, PLACE, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        again = rows.join(large, PLACE, "left_semi").select("word", "n", F.array(_range(F.col("m"), F.col("lo"), middle), _range(F.col("m"), middle, F.col("hi"))).alias("r"))
        rows = stage(_placed(again, F.col("r")), "places")


PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def near_words(vocabulary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words one inserted, deleted or replaced letter apart,
    once each. ``vocabulary``: different non-null words with their counts, staged."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            rows = rows_of(batches, *PLACE, "word", "n")
            for place, members in groupby(rows, itemgetter(0, 1, 2, 3, 4)):
                counts = {word: n for *_, word, n in members}
                if len(counts) > 1:
                    for x, y in near_pairs(*place, counts):
                        yield x, counts[x], y, counts[y]

        yield from batches_of(pairs(), PAIRS)

    placed = partitions(vocabulary, most_words).repartition(*PLACE).sortWithinPartitions(*PLACE)
    return placed.mapInArrow(compose, "a string, a_n bigint, b string, b_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles how far a word has followed, so rounds
    grow with the logarithm of the longest chain, which counts at least double along."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_groups(vocabulary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n).

    A word's form is its near word of the largest count, the smallest of several, if that is
    at least double the word's own; else null. ``root`` is where following forms ends. A word
    without near words has n_near 0. Null and repeated words, and other columns, are not
    for this function: ``word_counts`` gives neither. An empty vocabulary gives no rows.
    """
    words = stage(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(words, most_words)

    def side(word: str, near: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"{near}_n").alias("near_n"))

    both = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    is_form = -F.col("best.least") >= 2 * F.col("n")
    formed = stage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.least")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
