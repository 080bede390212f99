"""Vector codes by product quantisation, nearest entries found in a GNAT.

A vector is cut into equal parts and each part is coded by the nearest entry of its
position's codebook. The entries of a codebook stand in a geometric near-neighbour access
tree (Brin, 1995): a node has split points, every other entry goes to the nearest of them,
and for each pair of split point and child the node stores the range of their distances.
A search measures the distances to the split points and drops a child when one range says
that none of its entries can be as near as the best so far.

All components are integers. Ranges and query distances are rounded outwards and a child
is dropped on strict inequality alone, so that no equal distance is lost; what is left is
compared by exact integer squared distances, ties to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import stage
from citeloom.session import broadcast_small

#: Parts of a vector, entries of a codebook, rounds, scale of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Split points of a node.
DEGREE = 4

#: Doubles hold integers up to this exactly. Where a squared distance could be larger, the
#: same steps run on Python's integers.
EXACT_IN_DOUBLES = 1 << 53


def _squares(queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = queries - entry
    return (away * away).sum(axis=1)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below and above the roots of exact squares."""
    root = np.sqrt(squares.astype(np.float64))
    # The root is rounded correctly; very large squares are first rounded to a double.
    return root * (1 - 4e-16), root * (1 + 4e-16)


@dataclass
class Node:
    """``splits``: entry numbers; ``children``: nodes or None; ``low``, ``high``: by split
    point and child, the range of distances from the point to the child's entries."""

    splits: list[int]
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def build(entries: np.ndarray, members: list[int] | None = None, degree: int = DEGREE) -> Node:
    """The tree of the numbered entries. Split points are spread out: the first entry, then
    always the one farthest from those taken (ties to the lower number)."""
    members = list(range(len(entries))) if members is None else members
    points = entries[members]
    splits = [0]
    nearest = _squares(points, points[0])
    measured = [nearest]
    while len(splits) < min(degree, len(members)):
        nearest = np.where(np.isin(np.arange(len(members)), splits), -1, nearest)
        splits.append(int(np.argmax(nearest)))
        measured.append(_squares(points, points[splits[-1]]))
        nearest = np.minimum(nearest, measured[-1])
    table = np.array(measured)
    owner = np.argmin(table, axis=0)
    low, high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
    children: list[Node | None] = []
    for c in range(len(splits)):
        inside = [i for i in range(len(members)) if owner[i] == c and i not in splits]
        for s in range(len(splits)):
            if inside:
                below, above = _roots(table[s][inside])
                low[s, c], high[s, c] = below.min(), above.max()
        children.append(build(entries, [members[i] for i in inside], degree) if inside else None)
    return Node([members[s] for s in splits], children, low, high)


def nearest_entries(tree: Node | None, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every query the number of its nearest entry and the squared distance, ties to the
    lower number; and how many distances were measured."""
    best = np.full(len(queries), len(entries), np.int64)
    far = np.zeros(len(queries), queries.dtype)
    if not len(queries):
        return best, far, 0
    best[:] = tree.splits[0]
    far[:] = _squares(queries, entries[tree.splits[0]])
    measured = _search(tree, entries, queries, np.arange(len(queries)), best, far)
    return best, far, measured


def _search(node: Node, entries: np.ndarray, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, far: np.ndarray) -> int:
    here, below, above = queries[rows], [], []
    for entry in node.splits:
        squares = _squares(here, entries[entry])
        nearer = (squares < far[rows]) | ((squares == far[rows]) & (entry < best[rows]))
        won = rows[nearer]
        best[won], far[won] = entry, squares[nearer]
        down, up = _roots(squares)
        below.append(down)
        above.append(up)
    measured = len(rows) * len(node.splits)
    for c, child in enumerate(node.children):
        if child is None:
            continue
        # The radius shrinks as children are searched, so it is taken anew for each.
        radius = _roots(far[rows])[1]
        may = np.ones(len(rows), bool)
        for s in range(len(node.splits)):
            may &= ~((below[s] - radius) * (1 - 4e-16) > node.high[s, c]) & ~((above[s] + radius) * (1 + 4e-16) < node.low[s, c])
        if may.any():
            measured += _search(child, entries, queries, rows[may], best, far)
    return measured


class Codebooks:
    """Entries by part, and their trees. As large as entries times vector: bounded."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = []
        for part in entries:
            exact = np.empty(part.shape, object)
            exact[...] = [[int(x) for x in row] for row in part] if part.size else 0
            self.entries.append(exact)

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    def typed(self, kind: type) -> list[tuple[Node, np.ndarray]]:
        """(tree, entries) by part for queries of one kind of number."""
        known = self.__dict__.setdefault("_trees", {})
        if kind not in known:
            usual = [e if kind is object else e.astype(kind) for e in self.entries]
            known[kind] = [(build(e) if len(e) else None, e) for e in usual]
        return known[kind]

    def digest(self) -> str:
        numbers = (str(x) for part in self.entries for row in part for x in row)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry number by vector and part, squared distance by vector and part, and the
        distances measured."""
        largest = max([int(np.abs(vectors).max(initial=0)), *(abs(x) for part in self.entries for row in part for x in row)])
        longest = vectors.shape[1] // len(self.entries) * (2 * largest) ** 2
        kind = np.float64 if longest <= EXACT_IN_DOUBLES else object
        values = vectors.astype(kind)
        width = values.shape[1] // len(self.entries)
        numbers, errors, measured = [], [], 0
        for p, (tree, entries) in enumerate(self.typed(kind)):
            number, error, n = nearest_entries(tree, entries, np.ascontiguousarray(values[:, p * width : (p + 1) * width]))
            numbers.append(number)
            errors.append(error)
            measured += n
        return np.array(numbers).T.reshape(len(vectors), -1), np.array(errors).T.reshape(len(vectors), -1), measured


def whole_numbers(vectors: list[np.ndarray] | np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exact: a power of two only moves the exponent."""
    scaled = np.floor(np.asarray(vectors, np.float64) * scale)
    if np.abs(scaled).max(initial=0) < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object)


def _matrix(batch: pa.RecordBatch, column: str, parts: int) -> np.ndarray:
    lists = batch.column(column)
    sizes = np.unique(np.asarray(lists.value_lengths()))
    if len(sizes) > 1 or (len(sizes) and sizes[0] % parts):
        raise ValueError(f"vectors of sizes {sizes.tolist()}: need one size, a multiple of {parts}")
    width = int(sizes[0]) if len(sizes) else 0
    return whole_numbers(np.asarray(lists.flatten(), np.float64).reshape(len(lists), width))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def _first_entries(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """Those of the smallest ids, ascending; null ids last, equal ids by their vector."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    vectors = whole_numbers(np.array([row.vector for row in first], np.float64)) if first else np.empty((0, 0), np.int64)
    width = vectors.shape[1] // parts
    return Codebooks([vectors[:, p * width : (p + 1) * width] for p in range(parts)])


def _refined(kept: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """Entries replaced by the floor of the mean of their parts. Each task adds up its own
    vectors, so what is shuffled is one codebook per task; only sums come to the driver."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch, "vector", parts)
            width = vectors.shape[1] // parts
            sums = sums or [np.zeros((len(e), width), object) for e in books.entries]
            numbers, _, _ = books.assign(vectors)
            for p in range(parts):
                counts[p] += np.bincount(numbers[:, p], minlength=len(counts[p]))
                for e in np.unique(numbers[:, p]):
                    # Sums of a batch fit 64 bits unless the components do not.
                    chosen = vectors[numbers[:, p] == e, p * width : (p + 1) * width]
                    exact = chosen if np.abs(chosen).max(initial=0) < 1 << 40 else chosen.astype(object)
                    sums[p][e] += np.array([int(x) for x in exact.sum(axis=0)], object)
        rows = [
            (p, e, i, int(counts[p][e]), str(total))
            for p in range(parts)
            for e in np.flatnonzero(counts[p]).tolist()
            for i, total in enumerate(sums[p][e])
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "at", "n", "total"])

    sums = kept.select("vector").mapInArrow(add_up, "part int, entry int, at int, n bigint, total string")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    found = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), total.alias("total")).collect()
    entries = [e.copy() for e in books.entries]
    for row in found:
        entries[row.part][row.entry][row.at] = int(row.total) // row.n
    return Codebooks(entries)


def learn_codebooks(df: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all usable rows after ``rounds`` rounds; ``df`` should be a table, as it
    is read once a round. Without rows the codebooks are empty."""
    kept = usable(df, vector).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    books = _first_entries(kept, parts, entries)
    for _ in range(rounds):
        books = _refined(kept, books, parts)
    return books


def encode_vectors(df: DataFrame, books: Codebooks, vector: str, code: str = "code", error: str = "error") -> DataFrame:
    """``df``'s usable rows with ``code`` (two hex digits per part) and ``error`` (squared
    distances summed). Row-local; other columns stay; columns with these names are an
    error. An error beyond 64 bits is an error too."""
    if taken := {c.lower() for c in df.columns} & {code.lower(), error.lower()}:
        raise ValueError(f"the table has columns {sorted(taken)} already")
    kept = usable(df, vector)
    parts = len(books.entries)
    schema = kept.withColumn(code, F.lit("")).withColumn(error, F.lit(0).cast("bigint")).schema
    at = kept.columns.index(vector)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, errors, _ = books.assign(_matrix(batch, batch.schema.names[at], parts))
            codes = [bytes(row).hex() for row in numbers.astype(np.uint8)]
            sums = [int(x) for x in errors.sum(axis=1)]
            arrays = [*batch.columns, pa.array(codes, pa.string()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, code, error])

    return kept.mapInArrow(encode, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every usable row.

    Rows with a null vector, or with null or non-finite components, go. A null key stays and
    comes last when entries are chosen; repeated rows stay and count as often as they occur;
    ties go to the lower entry; all null labels are one label; other columns are not read,
    so their names may be any. Vectors of different sizes, or of a size that the parts do
    not divide, are an error. An empty table gives an empty one.
    """
    docs = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = learn_codebooks(docs, "vec_id", "vector")
    coded = stage(encode_vectors(docs, books, "vector").drop("vector"), "codes")
    # One row per label: partial sums, then a join that does not move a label's rows to one task
    # while the labels are few, and that adaptive execution splits when they are many.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    known = F.coalesce(F.xxhash64("label"), F.lit(0))
    per_label = broadcast_small(sums.select(F.col("label").alias("_label"), known.alias("_hash"), "label_error"))
    same = (known == F.col("_hash")) & F.col("label").eqNullSafe(F.col("_label"))
    return coded.join(per_label, same).select(F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
