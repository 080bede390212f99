"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

A merge list of finite length can look only so far ahead: whether a boundary between two
symbols stays is settled once a fixed number of symbols to its right is known. That number
is computed from the list (``sufficient_lookahead``). The encoder reads a text slice by
slice, merges a window of symbols, emits the tokens that end before the lookahead, and
goes on behind them; it holds one slice and one window, however long the text or a word
in it is. The decoder turns ids into bytes and bytes into text, and holds at most the
bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeloom.llm.common import append_columns, batches_of

SLICE_CHARS = 1 << 16

#: Words up to this many characters are looked up in a table of words met before. When it
#: would get more entries than this, it becomes the older half, in place of the one before.
CACHED_CHARS, CACHED_WORDS = 48, 1 << 19

#: Characters that a pre-token's match may look at behind its start before it is sure
#: ("'r" is a contraction only before "e").
LOOK_AHEAD = 3

#: The steps before the merges for which words of letters below this code point can be cut in
#: bulk. Of its characters none decomposes into others that a neighbour could join.
PLAIN = 0x250
PLAIN_STEPS = [
    "NFC",
    {"Regex": r"\s+"},
    "Lowercase",
    {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "ByteLevel",
]


@cache
def byte_symbols() -> tuple[str, ...]:
    """The symbol of each byte value: printable Latin-1 stands for itself, the others
    follow in order from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return tuple(chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256))


@cache
def _joins_before() -> frozenset[str]:
    """Characters that canonical composition may join to the character before them."""
    seconds = set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


def starts_anew(char: str) -> bool:
    """Whether a text may be cut before ``char`` without a change to its normal form."""
    if char.isascii():
        return True
    whole = unicodedata.normalize("NFD", char)
    return unicodedata.combining(whole[0]) == 0 and whole[0] not in _joins_before() and char not in _joins_before()


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols behind a boundary after which no text can change whether it stays.

    Let rule r merge (u, v). A boundary goes by r if v follows it and the boundary behind
    v is still there, and that one goes earlier only by a rule q < r whose left part ends v:
    v itself, or a part at the right edge of v's making while that part is not yet merged.
    So reach(r) = length(v) + max reach(q), and ranks only fall along such a chain. Needs a
    list in which the parts of a rule are made by earlier rules, each by one rule only.
    """
    rank_of: dict[str, int] = {}
    size: dict[str, int] = {}
    # Per left part: ranks of its rules, rising, and the largest reach up to each.
    ranks: dict[str, list[int]] = {}
    reaches: dict[str, list[int]] = {}
    most = 0

    def symbols(part: str) -> int:
        if part not in size:
            size[part] = len(part.removesuffix(suffix)) if suffix else len(part)
            if size[part] != 1:
                raise ValueError(f"the merge list uses {part!r} before it makes it")
        return size[part]

    for rank, (left, right) in enumerate(merges):
        whole = left + right
        if whole in rank_of:
            raise ValueError(f"the merge list makes {whole!r} twice")
        length = symbols(left) + symbols(right)
        part, bound, behind = right, rank, 0
        while True:
            at = bisect_left(ranks.get(part, ()), bound)
            if at:
                behind = max(behind, reaches[part][at - 1])
            if part not in rank_of:
                break
            bound = rank_of[part]
            part = merges[bound][1]
        reach = symbols(right) + behind
        most = max(most, reach)
        known = reaches.setdefault(left, [])
        known.append(max(reach, known[-1]) if known else reach)
        ranks.setdefault(left, []).append(rank)
        rank_of[whole], size[whole] = rank, length
    return most


class WordVocabulary:
    """A BPE file of the tokenizers library whose pre-tokens hold no white space and end in
    a marked symbol. It travels with the task; the tables made from it stay in the task.

    Normaliser and pre-token pattern are the file's own, run by the library on slices; the
    merges are done here. What this class does not know is an error: unknown-token,
    prefix and byte-fallback options, dropout, added tokens with stripping, decoders.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.source = file.read()

    def __getstate__(self) -> dict:
        return {"source": self.source}

    @cached_property
    def tables(self) -> Tables:
        return Tables(json.loads(self.source))


class Tables:
    def __init__(self, file: dict):
        model = file["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        odd = {k: model.get(k) for k, v in plain.items() if model.get(k) not in (v, False)}
        marked = [t for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])]
        if odd or marked or file.get("decoder"):
            raise ValueError(f"not supported: {odd or marked or file['decoder']}")
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = max(1, sufficient_lookahead(merges, self.suffix))
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        self.window = 4 * (self.lookahead + self.longest)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.added).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        # The library's own normaliser and pattern, without its model.
        bare = Tokenizer.from_str(json.dumps(file | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalise = bare.normalizer.normalize_str if bare.normalizer else str
        self.pretokens = bare.pre_tokenizer.pre_tokenize_str
        parts = [step.get("pattern", step["type"]) for step in file["normalizer"].get("normalizers", [])]
        parts += [step.get("pattern", step["type"]) for step in file["pre_tokenizer"].get("pretokenizers", [])]
        self.plain_pattern = parts == PLAIN_STEPS

    def merge(self, symbols: Iterable[str]) -> list[str]:
        """Tokens of a run of symbols: the lowest rule first, everywhere from left to right."""
        rank, none, parts = self.rank.get, len(self.rank), list(symbols)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            while True:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
                if at == len(ranks):
                    break
                ranks[at] = rank((parts[at], parts[at + 1]), none)
                # The next place of the same rule is to the right: what was made is no part of it.
                try:
                    at = ranks.index(best, at + 1)
                except ValueError:
                    break
        return parts

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rules for look-up in bulk: pairs of ids as numbers in order, their ranks, and
        by rank the id that is made."""
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0), np.array([self.ids[a + b] for a, b in self.rank], np.int64)

    @cached_property
    def _symbol_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """By byte, the id of its symbol inside a word and at its end."""
        return tuple(np.array([self.ids[c + suffix] for c in byte_symbols()], np.int64) for suffix in ("", self.suffix))

    @cached_property
    def plain_classes(self) -> np.ndarray:
        """By code point below PLAIN: letter, number or sign, which the file's pattern takes in
        runs, one by one and in runs; 0 for what it may treat otherwise (white space, control
        characters, what opens a contraction). Only for the pattern this was made for, and
        where normalisation is lower case alone."""
        classes = np.zeros(PLAIN + 1, np.uint8)
        if not self.plain_pattern:
            return classes
        for code in range(0x21, PLAIN):
            char = chr(code)
            kind = unicodedata.category(char)[0]
            if char != "'" and kind not in "CZ" and char.lower() == char:
                classes[code] = {"L": 1, "N": 2}.get(kind, 3)
        return classes

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole pre-tokens (in symbols), one after another, and how many each has."""
        values = {c: b for b, c in enumerate(byte_symbols())}
        given = np.fromiter((values[c] for w in words for c in w), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return self.merge_bytes(given, sizes)

    def merge_bytes(self, given: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` on many whole pre-tokens at once, a round for each one's lowest rule: their
        bytes one after another and the length of each, to ids and their number."""
        keys, ranks, made = self._pairs
        inside, ending = self._symbol_ids
        ids, word = inside[given], np.repeat(np.arange(len(sizes)), sizes)
        last = np.cumsum(sizes) - 1
        ids[last] = ending[given[last]]
        none = len(made)

        def rank_at(at: np.ndarray) -> np.ndarray:
            """Of the pair that starts at each place; ``none`` where no rule takes it."""
            after = np.minimum(at + 1, len(ids) - 1)
            pair = ids[at] << 32 | ids[after]
            found = np.searchsorted(keys, pair)
            return np.where((keys[found] == pair) & (word[at] == word[after]) & (after > at), ranks[found], none)

        rank = rank_at(np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = best == none
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            # Places in a row are a run of one symbol: every other one, from the left.
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            ids, word, rank = ids[stay], word[stay], rank[stay]
            changed = np.zeros(len(ids), bool)
            changed[moved] = changed[np.maximum(moved - 1, 0)] = True
            touched = np.flatnonzero(changed)
            rank[touched] = rank_at(touched)
        if not done:
            return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
        owner, found = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return found[order], np.bincount(owner, minlength=len(sizes))

    def ids_of(self, tokens: Iterable[str]) -> list[int]:
        return [self.ids[t] for t in tokens]


class WordStream:
    """The transducer of one pre-token: symbols in, ids out once they are stable."""

    def __init__(self, tables: Tables):
        self.tables, self.open = tables, []

    def feed(self, symbols: Iterable[str]) -> list[int]:
        t, out = self.tables, []
        self.open += symbols
        at = 0
        while len(self.open) - at >= t.window:
            ends = 0
            for token in t.merge(self.open[at : at + t.window]):
                ends += len(token)
                if ends > t.window - t.lookahead:
                    break
                out.append(t.ids[token])
                at += len(token)
        del self.open[:at]
        return out

    def finish(self) -> list[int]:
        """The rest, with the mark of a word's end on its last symbol."""
        rest, self.open = self.open, []
        if rest:
            rest[-1] += self.tables.suffix
        return self.tables.ids_of(self.tables.merge(rest))


class TextStream:
    """The transducer of a text: slices of any length in, ids out once they are stable.

    It holds what the end of the last slice leaves open: the start of an added token,
    characters that normalisation may join to the next, a pre-token of usual length, or
    the window of a longer one.
    """

    #: A pre-token longer than this is given on while its end is not known.
    LONG = 256

    def __init__(self, tables: Tables):
        self.tables = tables
        self.raw = self.normal = ""
        self.word: WordStream | None = None
        self.kind = ""

    def feed(self, text: str) -> list[int]:
        raw, self.raw, out = self.raw + text, "", []
        if self.tables.find_added:
            *closed, raw = self.tables.find_added.split(raw)
            for segment, added in zip(closed[::2], closed[1::2], strict=True):
                out += [*self._segment(segment, last=True), self.tables.added[added]]
        keep = len(raw)
        for added in self.tables.added:
            most = min(len(added) - 1, len(raw))
            keep = min(keep, next((len(raw) - n for n in range(most, 0, -1) if raw.endswith(added[:n])), keep))
        while keep > 0 and not starts_anew(raw[keep : keep + 1] or "́"):
            keep -= 1
        self.raw = raw[keep:]
        return out + self._segment(raw[:keep], last=False)

    def finish(self) -> list[int]:
        raw, self.raw = self.raw, ""
        return self._segment(raw, last=True)

    def _segment(self, raw: str, last: bool) -> list[int]:
        text = self.normal + (self.tables.normalise(raw) if raw else "")
        self.normal, out = "", []
        if self.word is not None:
            taken = self._goes_on(self.kind, text)
            out += self.word.feed(_symbols(text[:taken]))
            text = text[taken:]
            if text or last:
                out += self.word.finish()
                self.word = None
        if not text:
            return out
        for piece, (begin, end) in self.tables.pretokens(text):
            if last or max(end + 1, begin + LOOK_AHEAD) <= len(text):
                out += self._whole(piece)
            elif end - begin > self.LONG:
                self.kind = next(k for k in "a!" if self._goes_on(k, text[end - 1 :]))
                self.word = WordStream(self.tables)
                return out + self.word.feed(piece)
            else:
                self.normal = text[begin:]
                return out
        return out

    def _goes_on(self, kind: str, text: str) -> int:
        """Characters of ``text`` that a run of letters ("a") or signs ("!") takes."""
        return self.tables.pretokens(kind + text)[0][1][1] - 1

    def _whole(self, piece: str) -> list[int]:
        word = WordStream(self.tables)
        return word.feed(piece) + word.finish()


def _symbols(text: str) -> str:
    names = byte_symbols()
    return "".join([names[b] for b in text.encode()])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Words(dict):
    """Ids of words met before, as little-endian integers.

    White space parts pre-tokens and stops normalisation from joining characters, so that
    a word is a text. The words of a batch that are new go through the transducer together:
    each is shorter than the lookahead, so all its tokens are stable once its end is seen.
    """

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        stream = TextStream(self.tables)
        return _packed(stream.feed(word) + stream.finish())

    def learn(self, texts: Iterable[list[str]]) -> None:
        """The words of texts that are not known yet and not too long."""
        asked = {w for w in set().union(*texts) if len(w) <= CACHED_CHARS}
        new = {w for w in asked if w not in self}
        if len(self) + len(new) > CACHED_WORDS:
            # Words that are met again come back from the older half; the others go.
            self.older = dict(self)
            self.clear()
            new = asked
        if self.older:
            back = new & self.older.keys()
            self.update([(w, self.older.pop(w)) for w in back])
            new -= back
        opening = os.path.commonprefix(list(self.tables.added))
        odd = {w for w in new if opening in w} if self.tables.added else set()
        usual = list(new - odd)
        for at in range(0, len(usual), 1 << 14):
            odd.update(self._learn_plain(usual[at : at + (1 << 14)]))
        self.update([(w, self.__missing__(w)) for w in odd])

    def _learn_plain(self, words: list[str]) -> list[str]:
        """Learns the words whose characters are all plain; returns the others."""
        text = " ".join(words).lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        blank = points == 0x20
        classes = self.tables.plain_classes[np.minimum(points, PLAIN)]
        # Each word has a stretch that ends with its blank; the empty word is no pre-token.
        word = np.cumsum(blank) - blank
        bad = np.zeros(len(words), bool)
        bad[word[(classes == 0) & ~blank]] = True
        bad[np.diff(np.flatnonzero(np.concatenate([[True], blank, [True]]))) == 1] = True
        good = ~blank & ~bad[word]
        classes, word, points = classes[good], word[good], points[good]
        if len(points):
            new = np.concatenate([[True], (classes[1:] != classes[:-1]) | (classes[1:] == 2) | (word[1:] != word[:-1])])
            widths = 1 + (points >= 0x80)
            starts = np.flatnonzero(new)
            given = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids, sizes = self.tables.merge_bytes(given, np.add.reduceat(widths, starts))
            counts = np.bincount(word[starts], weights=sizes, minlength=len(words)).astype(np.int64)
            ends = (np.cumsum(counts) * 4).tolist()
            data = ids.astype("<u4").tobytes()
            self.update((w, data[a:b]) for w, a, b, skip in zip(words, [0, *ends[:-1]], ends, bad.tolist(), strict=True) if not skip)
        return [w for w, skip in zip(words, bad.tolist(), strict=True) if skip]


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def encode_stream(text: str, words: Words, slice_chars: int = SLICE_CHARS) -> Iterator[bytes]:
    """Ids of a text, slice by slice, as little-endian unsigned 32-bit integers."""
    at, end = 0, len(text)
    while at < end:
        stop = min(at + slice_chars, end)
        if stop < end:
            stop = text.rfind(" ", at, stop)
        if stop >= at:
            part = split_words(text[at:stop])
            words.learn([part])
            yield b"".join(map(words.__getitem__, part))
        else:
            # A word longer than a slice goes through one stream, slice by slice.
            stop = text.find(" ", at)
            stop = end if stop < 0 else stop
            stream = TextStream(words.tables)
            for part in range(at, stop, slice_chars):
                yield _packed(stream.feed(text[part : min(part + slice_chars, stop)]))
            yield _packed(stream.finish())
        at = stop + 1


def encode_batch(texts: list[str], words: Words) -> Iterator[Iterator[bytes]]:
    """``encode_stream`` of each text; the words of the short ones are learnt together."""
    lists = [split_words(t) if len(t) <= SLICE_CHARS else None for t in texts]
    words.learn(part for part in lists if part is not None)
    for text, part in zip(texts, lists, strict=True):
        yield encode_stream(text, words) if part is None else iter([b"".join(map(words.__getitem__, part))])


class IdsToText:
    """Ids in, text out: a machine over bytes that keeps an unfinished character.

    As the file has no decoder, the library gives the tokens' own strings with a blank
    between them; ``plain`` gives the text instead: symbols as the bytes they stand for,
    an end mark as a blank. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, tables: Tables, plain: bool = False):
        self.between = b"" if plain else b" "
        self.table = {i: self._bytes(name, tables, plain) for i, name in tables.names.items()}
        self.restart()

    @staticmethod
    def _bytes(name: str, tables: Tables, plain: bool) -> bytes:
        if not plain or name in tables.added:
            return name.encode()
        of = {s: b for b, s in enumerate(byte_symbols())}
        body = name.removesuffix(tables.suffix)
        return bytes(of[c] for c in body) + (b" " if body != name else b"")

    def restart(self) -> None:
        self.first, self.state = True, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        found = self.between.join(map(self.table.__getitem__, ids))
        if not found:
            return ""
        lead = b"" if self.first else self.between
        self.first = False
        return self.state.decode(lead + found)

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.restart()
        return rest


def encode_texts(df: DataFrame, vocabulary: WordVocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text in a new column ``ids array<int>``.

    Row-local. A null or empty text has none; repeated rows are repeated; a column ``ids``
    that is there already is an error; an empty table stays empty.
    """

    def compute(texts: list[str | None]) -> list[pa.Array]:
        found = [np.frombuffer(b"".join(parts), "<u4").astype(np.int32) for parts in encode_batch([t or "" for t in texts], _words_of(vocabulary))]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))]

    return append_columns(df, text, {ids: "array<int>"}, compute)


def decode_ids(df: DataFrame, vocabulary: WordVocabulary, ids: str = "ids", out: str = "decoded", plain: bool = False) -> DataFrame:
    """``df`` with the text of ``ids`` in a new column ``out``; see ``IdsToText``. Null
    ids give an empty text; an id that the file does not have is an error."""

    def compute(rows: list[list[int] | None]) -> list[pa.Array]:
        machine = IdsToText(vocabulary.tables, plain)
        return [pa.array([machine.feed(row or ()) + machine.finish() for row in rows], pa.string())]

    return append_columns(df, ids, {out: "string"}, compute)


def _words_of(vocabulary: WordVocabulary) -> Words:
    """The task's table of words."""
    if "words" not in vocabulary.__dict__:
        vocabulary.__dict__["words"] = Words(vocabulary.tables)
    return vocabulary.__dict__["words"]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoding_digests(df: DataFrame, vocabulary: WordVocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: each slice's ids are
    digested and decoded as they come, so that a text's ids are never held together.

    A null text counts as empty; null ids and repeated rows have their own rows; other
    columns are not read; an empty table gives an empty one.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, machine = _words_of(vocabulary), IdsToText(vocabulary.tables)

        def found() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, parts in zip(batch.column(0).to_pylist(), encode_batch(batch.column(1).to_pylist(), words), strict=True):
                    count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in parts:
                        count += len(ids) // 4
                        of_ids.update(ids)
                        of_text.update(machine.feed(np.frombuffer(ids, "<u4").tolist()).encode())
                    of_text.update(machine.finish().encode())
                    yield doc_id, count, of_ids.hexdigest(), of_text.hexdigest()

        yield from batches_of(found(), DIGESTS)

    return docs.mapInArrow(digest, DIGESTS_DDL)
