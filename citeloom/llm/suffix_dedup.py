"""Removal of repeated byte strings by bucket-pointer refinement.

As in the suffix sorter of that name (Schuermann and Stoye, 2005), suffixes start in
buckets of equal q-grams, and a bucket is refined by the bucket identifiers that its
suffixes have at later offsets; what one round finds is what the next one reads. Here
identifiers are hashes, so that buckets of a corpus can be split over tasks, and it is
enough to refine down to the length asked for:

1. Buckets of ``Q`` bytes. Of all suffixes only anchors take part: in each window of
   ``LENGTH`` bytes the suffix whose bucket identifier is least, which depends on nothing
   but the window's bytes. Equal windows have equal anchors, so none is missed.
2. The identifier of a window follows from the buckets at offsets 0, Q and LENGTH - Q, that
   of a region, all windows with one anchor, from its first and last window. Anchors of a
   bucket are sorted by region: where regions are equal, the least document keeps it.
3. Buckets with several regions are refined once more, window by window. Two regions of
   a bucket can only share a window if they agree on SIDE bytes before or after the anchor,
   so a byte of hash for each side tells most of those that share nothing more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import batches_of, parts_for, stage, utf8_size
from citeloom.llm.shingles import _BYTES, _PLACES, _grown, mix

LENGTH = 50
Q = 20

#: A window has an anchor and LENGTH - Q bytes more, so half of these on one side of it.
SIDE = (LENGTH - Q) // 2

#: Suffixes, or windows, that one task sorts at a time.
TASK_ENTRIES = 1_000_000

#: Bytes of text whose identifiers are computed at a time; a longer text is taken alone.
BLOCK = 1 << 19

NO_ID = np.iinfo(np.int64).max


@dataclass
class Windows:
    """Identifiers of one block of texts."""

    window: np.ndarray  # of the window at each byte
    text: np.ndarray  # per anchor: number of the text
    first: np.ndarray  # per anchor: its first and last window
    last: np.ndarray
    bucket: np.ndarray
    region: np.ndarray
    before: np.ndarray  # per anchor: a byte of hash of what stands before it, 0 for too little
    after: np.ndarray


def least_place(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours, the leftmost of equal ones."""
    places = np.arange(len(values), dtype=np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        right = values[step:] < values[:-step]
        places = np.where(right, places[step:], places[:-step])
        values = np.where(right, values[step:], values[:-step])
        have += step
    return places


def identify(raw: Sequence[bytes], length: int = LENGTH, q: int = Q) -> Windows:
    """Anchors of texts; windows do not cross from one text into the next."""
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Windows(none.astype(np.uint64), none, none, none, *[none.astype(np.uint64)] * 2, *[none.astype(np.uint8)] * 2)
    up, down = _grown(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTES[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    gram = mix((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])
    m = len(data) - length + 1
    window = mix(gram[:m] * _PLACES[0] + gram[q : q + m] * _PLACES[1] + gram[length - q : length - q + m] * _PLACES[2])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raw)), sizes)
    starts = np.flatnonzero(np.arange(m) + length <= ends[owner[:m]])
    place = least_place(gram, length - q + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, anchor = starts[at], place[at]
    last = starts[np.append(at[1:], len(starts)) - 1] if len(at) else none
    shape = ((anchor - first) * (2 * length) + (last - first)).astype(np.uint64)
    region = mix(window[first] * _PLACES[3] + window[last] * _PLACES[4] + shape)
    text = owner[first]
    before = side(sums, down, anchor - SIDE, ends[text] - sizes[text], ends[text])
    after = side(sums, down, anchor + q, ends[text] - sizes[text], ends[text])
    return Windows(window, text, first, last, gram[anchor], region, before, after)


def side(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """1 to 255, a hash of SIDE bytes from ``begin``; 0 where the text has not as many."""
    inside = (begin >= least) & (begin + SIDE <= most)
    at = np.where(inside, begin, 0)
    hashed = mix((sums[np.minimum(at + SIDE, len(sums) - 1)] - sums[at]) * down[at])
    return np.where(inside, 1 + hashed % np.uint64(255), 0).astype(np.uint8)


def blocks(raw: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, r in enumerate(raw):
        if size and size + len(r) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(r)
    if begin < len(raw):
        yield begin, len(raw)


def whole_id(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")


ENTRIES = pa.schema([("part", pa.int32()), ("rows", pa.int32()), ("columns", pa.binary()), ("known", pa.bool_())])
ENTRIES_DDL = "part int, rows int, columns binary, known boolean"
VERDICT = pa.schema([("doc_id", pa.int64()), ("region", pa.int64()), ("open", pa.bool_())])


def planes(values: np.ndarray) -> bytes:
    """The first byte of all values, then the second of all, and so on: high bytes of ids
    and of sorted hashes are much alike and take little room once compressed."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(raw: bytes, at: int, rows: int, kind) -> tuple[np.ndarray, int]:
    size = rows * np.dtype(kind).itemsize
    flat = np.frombuffer(raw, np.uint8, size, at).reshape(-1, rows)
    return np.ascontiguousarray(flat.T).view(kind).reshape(rows), at + size


#: Columns of entries to sort, and of those that are known to be covered.
SORTED = (np.uint64, np.uint64, np.int64, np.uint8, np.uint8)
KNOWN = (np.uint64, np.int64)


def dealt(bucket: np.ndarray, columns: Sequence[np.ndarray], parts: int, known: bool) -> Iterator[tuple]:
    """Entries as one row for each part they belong to. Only the bucket decides the part."""
    part = ((bucket >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    ordered = [c[order] for c in columns]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(part[a]), b - a, b"".join(planes(c[a:b]) for c in ordered), known


def least_first(bucket: np.ndarray, region: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by bucket, region and document, equal entries once; and, last, which are the
    first of their region."""
    order = np.lexsort((doc, region, bucket))
    bucket, region, doc = bucket[order], region[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (region[1:] != region[:-1]) | (bucket[1:] != bucket[:-1])
    keep = new.copy()
    keep[1:] |= doc[1:] != doc[:-1]
    return bucket[keep], region[keep], doc[keep], *[m[order][keep] for m in more], new[keep]


def read_anchors(df: DataFrame, parts: int) -> DataFrame:
    """Anchors of (doc_id, text) for the part that sorts their bucket. Of equal regions of
    a batch only the least document goes on; the others are known to be covered. Each text
    as a whole is one more region, and a text that repeats in a batch is just that."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            whole = np.array([whole_id(raw[i]) for i in order], np.uint64)
            _, once = np.unique(whole, return_index=True)  # the first, so the least document
            once = order[np.sort(once)]
            found = [(whole, whole, ids[order], *[np.zeros(len(whole), np.uint8)] * 2)]
            own = [raw[i] for i in once]
            for a, b in blocks(own):
                w = identify(own[a:b])
                found.append((w.bucket, w.region, ids[once[a:b]][w.text], w.before, w.after))
            *columns, least = least_first(*[np.concatenate(x) for x in zip(*found, strict=True)])
            yield from batches_of(dealt(columns[0][least], [c[least] for c in columns], parts, False), ENTRIES)
            # What is not the first of its region has a larger document.
            yield from batches_of(dealt(columns[0][~least], [c[~least] for c in columns[1:3]], parts, True), ENTRIES)

    return df.mapInArrow(read, ENTRIES_DDL)


def parts_of(batches: Iterator[pa.RecordBatch], kinds: Sequence) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The entries of each part of sorted rows: those to sort, and those known."""
    of = {False: kinds, True: KNOWN}
    held: dict[bool, list[list[np.ndarray]]] = {False: [], True: []}
    now = None

    def joined(known: bool) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, k), *[c[i] for c in held[known]]]) for i, k in enumerate(of[known])]

    for batch in batches:
        for part, rows, raw, known in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if part != now:
                if now is not None:
                    yield joined(False), joined(True)
                held, now = {False: [], True: []}, part
            columns, at = [], 0
            for kind in of[known]:
                column, at = unplaned(raw, at, rows, kind)
                columns.append(column)
            held[known].append(columns)
    if now is not None:
        yield joined(False), joined(True)


def by_part(entries: DataFrame, parts: int) -> DataFrame:
    return entries.repartition(parts, "part").sortWithinPartitions("part")


def verdict(doc: np.ndarray, region: np.ndarray, opened: bool, each: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), each):
        d = doc[i : i + each]
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(region[i : i + each].view(np.int64)), pa.array(np.full(len(d), opened))], schema=VERDICT)


def agreeing(bucket: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where another document's region of the bucket agrees on a side."""
    order = np.lexsort((side, bucket))
    b, s, d = bucket[order], side[order], doc[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
    out = np.zeros(len(b), bool)
    begins = np.flatnonzero(new)
    if len(begins):
        several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
        out[order] = several[np.cumsum(new) - 1] & (s > 0)
    return out


def sort_regions(entries: DataFrame, parts: int) -> DataFrame:
    """(doc_id, region, open): regions that an earlier document has too, and with ``open``
    the regions whose windows have to be looked at: the first of each of several regions
    in a bucket that agree on a side, in different documents."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, region, doc, before, after), (known_region, known_doc) in parts_of(batches, SORTED):
            yield from verdict(known_doc, known_region, False)
            bucket, region, doc, before, after, least = least_first(bucket, region, doc, before, after)
            yield from verdict(doc[~least], region[~least], False)
            bucket, region, doc, before, after = (c[least] for c in (bucket, region, doc, before, after))
            several = agreeing(bucket, before, doc) | agreeing(bucket, after, doc)
            yield from verdict(doc[several], region[several], True)

    return by_part(entries, parts).mapInArrow(judge, "doc_id bigint, region bigint, open boolean")


def read_windows(df: DataFrame, parts: int) -> DataFrame:
    """Windows of the open regions of (doc_id, text, regions), in the form of anchors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = [np.array(r, np.int64).view(np.uint64) for r in batch.column(2).to_pylist()]
            found = []
            for a, b in blocks(raw):
                w = identify(raw[a:b])
                # A region is open for a document; the pair is looked up as one number.
                ask = np.concatenate([paired(np.full(len(r), i), r) for i, r in enumerate(wanted[a:b])])
                take = np.flatnonzero(np.isin(paired(w.text, w.region), ask))
                counts = w.last[take] - w.first[take] + 1
                where = np.repeat(w.first[take] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                found.append((w.window[where], ids[a:b][np.repeat(w.text[take], counts)]))
            windows, doc = [np.concatenate(x) for x in zip(*found, strict=True)] if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            windows, _, doc, least = least_first(windows, windows, doc)
            for known in (False, True):
                some = least ^ known
                yield from batches_of(dealt(windows[some], [windows[some], doc[some]], parts, known), ENTRIES)

    return df.mapInArrow(read, ENTRIES_DDL)


def sort_windows(entries: DataFrame, parts: int) -> DataFrame:
    """(doc_id, region): windows that an earlier document has too."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, doc), (known_region, known_doc) in parts_of(batches, KNOWN):
            yield from verdict(known_doc, known_region, False)
            _, region, doc, least = least_first(region, region, doc)
            yield from verdict(doc[~least], region[~least], False)

    return by_part(entries, parts).mapInArrow(judge, "doc_id bigint, region bigint, open boolean").select("doc_id", "region")


def paired(number: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix(name + number.astype(np.uint64) * _PLACES[5])


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, and with ``keep`` the bytes
    that stay, as ``kept``.

    A byte goes if it lies in a string of ``LENGTH`` bytes that starts in a document with a
    smaller id as well. Strings do not cross documents and are looked up in the input.
    ``spans`` are the maximal removed runs. A null text counts as empty; a null id as larger
    than all others. Rows with one id do not cover each other, as none is smaller; repeated
    rows have equal results. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text")
    size = docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    parts = parts_for(size / 15, TASK_ENTRIES, spark)

    judged = stage(sort_regions(read_anchors(ordered, parts), parts), "regions")
    asked = judged.where("open").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("region").alias("regions"))
    opened = ordered.join(asked, ordered["_id"] == asked["_doc"]).select("_id", "text", "regions")
    windows = stage(sort_windows(read_windows(opened, parts), parts), "windows")

    covered = judged.where("not open").select("doc_id", "region").unionByName(windows)
    covered = covered.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("region").alias("_covered"))
    joined = docs.join(covered, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_doc"), "left").drop("_doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *remove((t or "").encode(), c)) for d, t, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)]
            yield from batches_of((r if keep else (*r[:5], None, r[6]) for r in rows), CUT, weight=lambda r: len(r[5] or b""))

    return joined.select("doc_id", "text", "_covered").mapInArrow(cut, CUT_DDL).drop(*([] if keep else ["kept"]))


CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", _SPANS)]
)
CUT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<begin:bigint,end:bigint>>"


def remove(raw: bytes, covered: list[int] | None) -> tuple:
    """n_bytes, n_removed, n_spans, kept_sha256, kept, spans of one text, by the identifiers
    of its regions and windows, or of the whole text, that are covered."""
    gone = np.zeros(len(raw) + 1, np.int64)
    if covered and len(raw) >= LENGTH:
        names = np.array(covered, np.int64).view(np.uint64)
        if (names == np.uint64(whole_id(raw))).any():
            gone[0], gone[len(raw)] = 1, -1
        else:
            w = identify([raw])
            full = np.isin(w.region, names)
            np.add.at(gone, w.first[full], 1)
            np.add.at(gone, w.last[full] + LENGTH, -1)
            single = np.flatnonzero(np.isin(w.window, names))
            gone[single] += 1
            gone[single + LENGTH] -= 1
    out = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
    spans = [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
    kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
    return len(raw), int(out.sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans
