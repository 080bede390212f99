"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks that overlap. Chunks are pre-tokenised in parallel; two
neighbours are stitched at a pre-token boundary that both found in their overlap. From
there on their boundaries agree, because a match of the pattern depends only on what
follows its start. The stretches between the stitches are pieces that can be encoded
apart, in parallel again. A text of one chunk is one piece and needs no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import batches_of, rows_of

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512

#: Characters after a pre-token's start that its match may look at without taking them
#: ("'r" is a contraction only before "e").
LOOK_AHEAD = 3

#: Bytes of ids that one batch of short texts holds.
IDS_BYTES = 1 << 20


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that splits text before the merges.

    Small and fixed (about a megabyte); it travels with the task, so that executors need
    no file of the driver. The tables built from it are larger: they belong to the task's
    copy and go with it, so that idle workers hold none.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = lines.read()
        self.pattern = pattern

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    def encoding(self) -> tiktoken.Encoding:
        return self._tables

    @cached_property
    def _tables(self) -> tiktoken.Encoding:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.ranks.splitlines()) if token}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})

    def splitter(self) -> regex.Pattern:
        return regex.compile(self.pattern)


def encode_piece(text: str, vocabulary: Vocabulary) -> np.ndarray:
    return np.asarray(vocabulary.encoding().encode_ordinary(text), dtype="<u4")


def boundaries(text: str, splitter: regex.Pattern, begin: int = 0) -> np.ndarray:
    """Pre-token starts of ``text`` from ``begin`` on, without those that text after the
    end could move."""
    found = [m.start() for m in splitter.finditer(text, begin)]
    # The start of a pre-token is sure once the one before it could not have gone on.
    sure = [b for a, b in zip(found, found[1:], strict=False) if max(b + 1, a + LOOK_AHEAD) <= len(text)]
    return np.array(found[:1] + sure, np.int64)


def split_chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(number, offset, text) of chunks that reach ``overlap`` into both neighbours."""
    for number, at in enumerate(range(0, max(len(text), 1), chunk)):
        begin = max(0, at - overlap)
        yield number, begin, text[begin : at + chunk + overlap]


def stitch(chunks: Iterator[tuple[int, str, np.ndarray]], splitter: regex.Pattern) -> Iterator[str]:
    """Pieces of one text from its chunks (offset, text, boundaries), in order.

    ``held`` is text from a true boundary on, whose own boundaries ``marks`` are true. The
    next chunk is joined at the first boundary that both have and that follows no white
    space: white space at the end of a piece would be split otherwise than inside. Where
    the overlap has no such place, as in a very long run of letters, the chunk's new text
    is added to what is held and split again from there.
    """
    held, start, marks = "", 0, np.zeros(0, np.int64)
    for offset, text, found in chunks:
        if not held:
            held, start, marks = text, offset, found + offset
            continue
        common = np.intersect1d(marks, found[1:] + offset, assume_unique=True)
        cut = next((int(c) for c in common if c > start and not held[c - start - 1].isspace()), None)
        if cut is not None:
            yield held[: cut - start]
            held, start, marks = text[cut - offset :], cut, found[found + offset >= cut] + offset
        else:
            known = int(marks[-1])
            held += text[start + len(held) - offset :]
            again = boundaries(held, splitter, known - start) + start
            marks = np.concatenate([marks[:-1], again])
    if held:
        yield held


CHUNKS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("no", pa.int64()), ("offset", pa.int64()), ("text", pa.string())])
CHUNKS_DDL = "doc_id bigint, key bigint, no bigint, offset bigint, text string"
SPLIT = pa.schema([*CHUNKS, ("marks", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("no", pa.int64()), ("text", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("no", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_DDL = "doc_id bigint, key bigint, no bigint, ids binary"
DIGESTS_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int, Iterator[tuple]]]:
    """Sorted rows (doc_id, key, no, ...) by text: the key, how many rows of the table
    have this very text and id, and the rows with repeats left out."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        name, copies = ahead[:2], 0
        first = []
        while ahead is not None and ahead[:2] == name and ahead[2] == 0:
            first = first or [ahead]
            copies, ahead = copies + 1, next(rows, None)

        def once(row=first[0] if first else None):
            nonlocal ahead
            if row is not None:
                yield row
            seen = 0
            while ahead is not None and ahead[:2] == name:
                if ahead[2] != seen:
                    seen = ahead[2]
                    yield ahead
                ahead = next(rows, None)

        rest = once()
        yield name, copies, rest
        for _ in rest:
            pass


def encode_texts(
    df: DataFrame,
    vocabulary: Vocabulary,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    use: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ids of every whole text, as rows (doc_id, key, no, ids).

    ``ids`` are little-endian unsigned 32-bit integers of one piece; ``no`` orders the
    pieces of a text and ``key`` is a hash of it. The first table has the texts of one
    chunk, one row each; the second the longer ones, sorted by (doc_id, key, no) inside
    partitions that hold whole texts. A null text counts as empty and has one row without
    ids; rows with equal id and text each have their own rows; other columns are not
    read; an empty table gives two empty ones.

    With ``use``, a function of batches of these rows and the columns of what it gives, the
    tables are what it makes of the ids. It takes short texts in the process that encodes
    them: two processes a task would each hold the vocabulary's tables.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(said, F.length(said)).alias("key"), said.alias("text"))
    # Not by filter on length alone: a null length would lose the row, but texts are never null here.
    short, long = docs.where(F.length("text") <= chunk), docs.where(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((d, k, 0, encode_piece(t, vocabulary).tobytes()) for d, k, t in rows_of(batches, "doc_id", "key", "text"))
        yield from batches_of(found, IDS, weight=lambda r: len(r[3]), most=IDS_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((d, k, *c) for d, k, t in rows_of(batches, "doc_id", "key", "text") for c in split_chunks(t, chunk, overlap))
        yield from batches_of(found, CHUNKS, weight=lambda r: len(r[4]))

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = vocabulary.splitter()

        def near_ends(t: str) -> bytes:
            marks = boundaries(t, splitter)
            # Only the overlaps can be stitched; the last mark is where to go on without.
            near = (marks <= 2 * overlap) | (marks >= len(t) - 2 * overlap)
            near[-1:] = True
            return marks[near].tobytes()

        found = ((d, k, n, o, t, near_ends(t)) for d, k, n, o, t in rows_of(batches, "doc_id", "key", "no", "offset", "text"))
        yield from batches_of(found, SPLIT, weight=lambda r: len(r[4]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = vocabulary.splitter()

        def pieces() -> Iterator[tuple]:
            for name, copies, chunks in _runs(rows_of(batches, "doc_id", "key", "no", "offset", "text", "marks")):
                parts = stitch(((o, t, np.frombuffer(m, np.int64)) for *_, o, t, m in chunks), splitter)
                for no, piece in enumerate(parts):
                    for _ in range(copies if no == 0 else 1):
                        yield (*name, no, piece)

        yield from batches_of(pieces(), PIECES, weight=lambda r: len(r[3]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((d, k, n, encode_piece(t, vocabulary).tobytes()) for d, k, n, t in rows_of(batches, "doc_id", "key", "no", "text"))
        yield from batches_of(found, IDS, weight=lambda r: len(r[3]))

    by_text = ["doc_id", "key"]
    chunks = long.mapInArrow(cut, CHUNKS_DDL).repartition("doc_id", "key", "no").mapInArrow(pretokenise, CHUNKS_DDL + ", marks binary")
    pieces = chunks.repartition(*by_text).sortWithinPartitions("doc_id", "key", "no").mapInArrow(join, "doc_id bigint, key bigint, no bigint, text string")
    encoded = pieces.repartition("doc_id", "key", "no").mapInArrow(encode, IDS_DDL)
    by_piece = encoded.repartition(*by_text).sortWithinPartitions("doc_id", "key", "no")
    if use is None:
        return short.mapInArrow(whole, IDS_DDL), by_piece
    work, columns = use
    return short.mapInArrow(lambda batches: work(whole(batches)), columns), by_piece.mapInArrow(work, columns)


def digest_batches(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``digests`` does with the batches of a partition."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.encoding()

        def found() -> Iterator[tuple]:
            for (doc_id, _), copies, pieces in _runs(rows_of(batches, "doc_id", "key", "no", "ids")):
                count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for *_, ids in pieces:
                    count += len(ids) // 4
                    of_ids.update(ids)
                    of_bytes.update(decode_ids(ids, coder))
                for _ in range(copies):
                    yield doc_id, count, of_ids.hexdigest(), of_bytes.hexdigest()

        yield from batches_of(found(), DIGESTS)

    return digest


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per text: number of ids, digest of the ids, digest of the bytes they decode to.

    ``encoded`` is one of the two tables of ``encode_texts``; its rows are streamed.
    """
    return encoded.mapInArrow(digest_batches(vocabulary), DIGESTS_DDL)


def decode_ids(ids: bytes, coder: tiktoken.Encoding) -> bytes:
    """The bytes of ids: those of each token, one after another."""
    return coder.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encoding_digests(df: DataFrame, vocabulary: Vocabulary, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; see ``encode_texts``."""
    short, long = encode_texts(df, vocabulary, use=(digest_batches(vocabulary), DIGESTS_DDL), **options)
    return short.unionByName(long)
