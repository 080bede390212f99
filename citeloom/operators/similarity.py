"""Claims against topics: cosine similarity and the best topics per claim.

The topics table is the large side. While the claims are small (``BROADCAST_BYTES``,
counted first) they go to the tasks as one broadcast matrix, in parts if they are many, and
the topics are read once for each part, where they lie: each task keeps the best ``k`` topics
per claim of its own partition, so at most ``k`` rows per claim and task leave it. Beyond that
topics are grouped around pivots; where claims can leave most groups out, the nearest are found
by them (``operators.pivots``), and where they cannot, the claims are broadcast in rounds, up to
``MOST_ROUNDS``. Figures over all topics go by a grid of cells of bounded size. No (claim,
topic) pair is written out that is not among a task's best.

The best are looked for in single precision: a product that is below the claim's k-th best so
far by more than the rounding of such a sum cannot be among them. What is left, a few pairs
for each claim, is worked out in double precision, and that alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.vectors import LANES, NORM_TOLERANCE, has_unit_norm, has_valid_size

# Fixed value: topics reported per claim.
TOPIC_MATCHES = 5

BROADCAST_BYTES = 256 * 1024 * 1024

# A side of a grid's cell: at most so many rows and, as doubles, bytes; a side is cut into
# fewer rows, while they are more than the least, to keep all cores at work.
CELL_ROWS, CELL_BYTES, LEAST_CELL_ROWS = 100_000, 64 << 20, 1024

# Similarities are compared at this resolution, finer than single precision, so that
# equal vectors tie wherever they lie in a block. Ties go to the lower topic id.
SIM_DECIMALS = 9

# Broadcasts of claims for one search, at most: each passes the driver once and stays there.
MOST_ROUNDS = 8

# Many claims are broadcast in parts of this many at least, until there are so many tasks for a
# core. A task that sees more topics knows sooner what is to beat, and fewer rows leave it, so
# topics are then scanned in fewer partitions.
PART_CLAIMS, TASKS_PER_CORE = 1 << 15, 4

# Share of the (claim, topic) pairs up to which groups are worth the copies they make.
GROUPS_PAY = 0.25

# Sizes of one matrix product inside a task: a product of 4 MB, which its core's cache almost holds.
CLAIM_ROWS, FIRST_ROWS, TOPIC_ROWS, PAIR_ROWS = 512, 512, 2048, 1 << 16

MATCH_SCHEMA = "claim_id bigint, topic_id bigint, sim double"
STATS_SCHEMA = "claim_id bigint, n_topics bigint, n_positive bigint, sim_sum double, sim_max double"


def dim_check(topics: DataFrame, vector_col: str = "topic_vector") -> DataFrame:
    """Rows whose vector size is not a positive multiple of the lane count."""
    return topics.where(F.col(vector_col).isNotNull() & ~has_valid_size(F.col(vector_col)))


def unit_norm_check(topics: DataFrame, vector_col: str = "topic_vector") -> DataFrame:
    """Rows whose vector is not of unit length."""
    return topics.where(F.col(vector_col).isNotNull() & ~has_unit_norm(F.col(vector_col)))


def slot_present(topics: DataFrame, vector_col: str = "topic_vector") -> DataFrame:
    return topics.where(F.col(vector_col).isNotNull())


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix. Fails on vectors of different or unusable size, and
    on vectors that are not of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(np.asarray(column.value_lengths()))
    if len(sizes) > 1 or (len(sizes) == 1 and (sizes[0] == 0 or sizes[0] % LANES)):
        raise ValueError(f"vector sizes {sizes.tolist()}: need one size, a multiple of {LANES}")
    values = np.asarray(column.flatten(), dtype=np.float64)
    matrix = values.reshape(len(column), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    if np.any(np.abs(norms - 1.0) > NORM_TOLERANCE):
        raise ValueError("vector outside the accepted range of lengths")
    return matrix


def best_per_claim(claim: np.ndarray, topic: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each claim, in order; lastly their ranks, from 0."""
    order = np.lexsort((topic, -sim, claim))
    claim, topic, sim = claim[order], topic[order], sim[order]
    starts = np.flatnonzero(np.r_[True, claim[1:] != claim[:-1]]) if len(claim) else np.empty(0, np.int64)
    rank = np.arange(len(claim)) - np.repeat(starts, np.diff(np.r_[starts, len(claim)]))
    keep = rank < k
    return claim[keep], topic[keep], sim[keep], rank[keep]


# Factors of the sum that tells vectors apart.
_ODD = np.random.default_rng(0).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def first_copies(topics: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Topics without those that ``k`` equal ones of lower id come before, whatever the claim."""
    # Equal vectors have equal sums of their bits, so most parts are known to have no copies.
    bits = np.ascontiguousarray(topics).view(np.uint32).astype(np.uint64)
    sums = np.sort(bits @ _ODD[: bits.shape[1]]) if bits.shape[1] <= len(_ODD) else np.zeros(len(bits))
    if len(sums) <= k or not (sums[k:] == sums[:-k]).any():
        return topics, ids
    _, group = np.unique(topics, axis=0, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    spare = group[k:] == group[:-k]
    if not spare.any():
        return topics, ids
    keep = order[np.r_[np.ones(min(k, len(order)), bool), ~spare]]
    return topics[keep], ids[keep]


class TopicsPerClaim:
    """Running best ``k`` positive similarities per claim. ``floor``: what is known to be
    reached by ``k`` topics of each claim; lower ones are left out."""

    schema = pa.schema([("claim_id", pa.int64()), ("topic_id", pa.int64()), ("sim", pa.float64())])

    def __init__(self, claim_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.claim_ids, self.k = claim_ids, k
        self.floor = np.zeros(len(claim_ids)) if floor is None else floor.copy()
        # Per claim, best first; a similarity of zero is a place not taken.
        self.topics, self.sims = np.zeros((len(claim_ids), k), np.int64), np.zeros((len(claim_ids), k))
        self.product = np.empty(CLAIM_ROWS * TOPIC_ROWS, np.float32)

    def scan(self, claims: np.ndarray, ids: np.ndarray, topics: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Topics against all claims, or against those in ``rows`` (their numbers, ascending)."""
        # A sum of n products of unit vectors in single precision is off by n units at most.
        slack = np.float32((claims.shape[1] + 8) * 2.0**-23) if len(claims) else np.float32(0)
        # Few topics first, where there is nothing to beat yet.
        starts = [*range(0, len(topics), TOPIC_ROWS)] if self.floor.all() else [0, *range(FIRST_ROWS, len(topics), TOPIC_ROWS)]
        for t, end in zip(starts, [*starts[1:], len(topics)]):
            part, part_ids = first_copies(topics[t:end], ids[t:end], self.k)
            for c in range(0, len(claims) if rows is None else len(rows), CLAIM_ROWS):
                block = slice(c, c + CLAIM_ROWS)
                self._add(block if rows is None else rows[block], claims, part, part_ids, slack)

    def _add(self, rows: slice | np.ndarray, claims: np.ndarray, topics: np.ndarray, ids: np.ndarray, slack: np.float32) -> None:
        own = claims[rows]
        rough = np.matmul(own, topics.T, out=self.product[: len(own) * len(topics)].reshape(len(own), len(topics)))
        floor = self.floor[rows].copy()
        new = np.flatnonzero(floor == 0)
        if len(new) and rough.shape[1] >= self.k:
            # Nothing to beat yet: these topics alone say what is worth a closer look.
            known = np.nan_to_num(rough[new], copy=False, nan=-np.inf)
            floor[new] = np.maximum(0, np.partition(known, -self.k, axis=1)[:, -self.k] - slack)
        floor = floor.astype(np.float32) - slack
        # Most claims have nothing here, which their maximum tells; that of a row with a NaN does not.
        near = np.flatnonzero(~(rough.max(axis=1, initial=-np.inf) < floor))
        row, col = np.divmod(np.flatnonzero(rough[near] >= floor[near, None]), max(1, rough.shape[1]))
        row = near[row]
        sim = np.empty(len(row))
        for at in range(0, len(row), PAIR_ROWS):
            left, right = own[row[at : at + PAIR_ROWS]], topics[col[at : at + PAIR_ROWS]]
            sim[at : at + PAIR_ROWS] = np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64))
        np.round(sim, SIM_DECIMALS, out=sim)
        claim = row + rows.start if isinstance(rows, slice) else rows[row]
        found = (sim >= self.floor[claim]) & (sim > 0)
        if not found.any():
            return
        claim, topic, sim = claim[found], ids[col[found]], sim[found]
        # Only claims with something new are ranked again.
        changed = np.unique(claim)
        held, place = np.nonzero(self.sims[changed])
        held = changed[held]
        known = (held, self.topics[held, place], self.sims[held, place])
        claim, topic, sim, rank = best_per_claim(*(np.concatenate(pair) for pair in zip(known, (claim, topic, sim))), self.k)
        self.topics[claim, rank], self.sims[claim, rank] = topic, sim
        last = rank == self.k - 1
        self.floor[claim[last]] = np.maximum(self.floor[claim[last]], sim[last])

    def result(self) -> list[np.ndarray]:
        claim, place = np.nonzero(self.sims)
        return [self.claim_ids[claim], self.topics[claim, place], self.sims[claim, place]]


class StatsPerClaim:
    """Running count, positive count, sum and maximum of the similarities."""

    schema = pa.schema(
        [
            ("claim_id", pa.int64()),
            ("n_topics", pa.int64()),
            ("n_positive", pa.int64()),
            ("sim_sum", pa.float64()),
            ("sim_max", pa.float64()),
        ]
    )

    def __init__(self, claim_ids: np.ndarray):
        n = len(claim_ids)
        self.claim_ids = claim_ids
        self.count, self.positive = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.total, self.top = np.zeros(n), np.full(n, -np.inf)

    def scan(self, claims: np.ndarray, ids: np.ndarray, topics: np.ndarray) -> None:
        for t in range(0, len(topics), TOPIC_ROWS):
            part = topics[t : t + TOPIC_ROWS].astype(np.float64).T
            for c in range(0, len(claims), CLAIM_ROWS):
                rows = slice(c, c + CLAIM_ROWS)
                sims = claims[rows].astype(np.float64) @ part
                np.round(sims, SIM_DECIMALS, out=sims)
                self.count[rows] += sims.shape[1]
                self.positive[rows] += (sims > 0).sum(axis=1)
                self.total[rows] += sims.sum(axis=1)
                self.top[rows] = np.maximum(self.top[rows], sims.max(axis=1))

    def result(self) -> list[np.ndarray]:
        seen = self.count > 0
        return [a[seen] for a in (self.claim_ids, self.count, self.positive, self.total, self.top)]


def to_singles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A checked matrix of a column of single-precision vectors, without loss."""
    return to_matrix(column).astype(np.float32)


def _scan_topics(batches: Iterator[pa.RecordBatch], claims, reducer: Callable) -> Iterator[pa.RecordBatch]:
    claim_ids, matrix = claims.value
    state = reducer(claim_ids)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def scan() -> None:
        state.scan(matrix, np.concatenate([ids for ids, _ in held]), np.concatenate([topics for _, topics in held]))
        held.clear()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        topics = to_singles(batch.column("vector"))
        if len(matrix) and topics.shape[1] != matrix.shape[1]:
            raise ValueError("claims and topics differ in vector size")
        if held and topics.shape[1] != held[0][1].shape[1]:
            scan()
        held.append((np.asarray(batch.column("topic_id")), topics))
        if sum(len(ids) for ids, _ in held) >= TOPIC_ROWS:
            scan()
    if held:
        scan()
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in state.result()], schema=state.schema)


def scan_cell(claims: pa.Table, topics: pa.Table, reducer: Callable) -> pa.Table:
    state = reducer(np.asarray(claims.column("claim_id")))
    if claims.num_rows and topics.num_rows:
        state.scan(to_singles(claims.column("vector")), np.asarray(topics.column("topic_id")), to_singles(topics.column("vector")))
    return pa.Table.from_arrays([pa.array(a) for a in state.result()], schema=state.schema)


def _claim_numbers(claims: DataFrame) -> tuple[int, int]:
    """Claims, and the numbers in their vectors."""
    return tuple(claims.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0))).first())


def _claims(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.col("vector").cast("array<float>").alias("vector"))


def _topics(topics: DataFrame) -> DataFrame:
    return topics.where("vector is not null").select("topic_id", F.col("vector").cast("array<float>").alias("vector"))


def _scan_all(claims: DataFrame, topics: DataFrame, reducer: Callable, schema: str, rounds: int = 1, parts: int = 1) -> DataFrame:
    """Per-task results of ``reducer``; the claims are a broadcast matrix, checked before. They are
    collected in ``rounds``, and each round is broadcast in ``parts``."""
    found = None
    for number in range(rounds):
        mine = claims if rounds == 1 else claims.where(F.pmod(F.xxhash64("claim_id", "vector"), F.lit(rounds)) == number)
        local = mine.toArrow()
        ids, matrix = np.asarray(local.column("claim_id")), to_singles(local.column("vector")) if local.num_rows else np.empty((0, 0), np.float32)
        cuts = np.linspace(0, len(ids), parts + 1).astype(int)
        for start, end in zip(cuts[:-1], cuts[1:]):
            shared = topics.sparkSession.sparkContext.broadcast((ids[start:end], matrix[start:end]))
            part = topics.mapInArrow(partial(_scan_topics, claims=shared, reducer=reducer), schema)
            found = part if found is None else found.unionByName(part)
    return found


def rows_of_cell(n: int, size: int, cores: int, most: int = CELL_ROWS) -> int:
    """Rows of a cell's side, of ``n`` with ``size`` numbers each. It goes by the memory of a
    task, so that a row is sent to few cells, and by the cores while the rows are few."""
    fits = max(1, min(most, CELL_BYTES // (8 * max(1, size))))
    return min(fits, max(LEAST_CELL_ROWS, -(-n // math.isqrt(4 * cores))))


def _scan_grid(claims: DataFrame, topics: DataFrame, reducer: Callable, schema: str, n_claims: int, size: int) -> DataFrame:
    """Results of ``reducer`` per cell of claims and topics. What is shuffled is both sides
    once per row or column of cells; how many claims can be broadcast does not matter here."""
    cores = claims.sparkSession.sparkContext.defaultParallelism
    n_topics = topics.count()
    claim_cells = -(-n_claims // rows_of_cell(n_claims, size, cores))
    topic_cells = max(1, -(-n_topics // rows_of_cell(n_topics, size, cores)))
    left = claims.withColumn("_c", F.pmod(F.xxhash64("claim_id"), F.lit(claim_cells))).withColumn(
        "_t", F.explode(F.sequence(F.lit(0), F.lit(topic_cells - 1)))
    )
    right = topics.withColumn("_t", F.pmod(F.xxhash64("topic_id"), F.lit(topic_cells)).cast("int")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(claim_cells - 1)).cast("array<bigint>"))
    )

    def cell(c, t):
        return scan_cell(c, t, reducer)

    return left.groupBy("_c", "_t").cogroup(right.groupBy("_c", "_t")).applyInArrow(cell, schema)


def topk_topics(
    claims: DataFrame, topics: DataFrame, k: int = TOPIC_MATCHES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The ``k`` nearest topics per claim with positive similarity.

    ``claims``: ``claim_id bigint, vector``; ``topics``: ``topic_id bigint, vector``.
    Returns ``claim_id, topic_id, sim, rank`` (from 1). For more claims than can be broadcast at
    once topics are grouped, and a sample of the claims tells whether groups are looked up or
    the claims broadcast in rounds, with the same result; give staged tables then, as they are
    read several times. So are the topics of many claims, once for each part of these.
    """
    # Groups reduce what this module computes, so they import it.
    from citeloom.operators.pivots import group_topics, grouped_topk, visited_share

    n_claims, numbers = _claim_numbers(claims)
    rounds = max(1, -(-numbers * 8 // max(1, broadcast_bytes)))
    if rounds > 1:
        groups = group_topics(topics)
        if rounds > MOST_ROUNDS or visited_share(groups, claims, k) <= GROUPS_PAY:
            return grouped_topk(claims, groups, k).matches
        topics = groups.topics
    parts, vectors = 1, _topics(topics)
    if n_claims >= 2 * rounds * PART_CLAIMS:
        tasks = TASKS_PER_CORE * claims.sparkSession.sparkContext.defaultParallelism
        parts = max(1, min(tasks, n_claims // PART_CLAIMS) // rounds)
        vectors = vectors.coalesce(-(-tasks // (rounds * parts)))
    partial_best = _scan_all(_claims(claims), vectors, partial(TopicsPerClaim, k=k), MATCH_SCHEMA, rounds, parts)
    order = Window.partitionBy("claim_id").orderBy(F.desc("sim"), "topic_id")
    return partial_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def claim_topic_sim(claims: DataFrame, topics: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All similarities of a claim, summed up: ``claim_id, n_topics, n_positive,
    sim_sum, sim_max``. The single values are never written out."""
    n_claims, numbers = _claim_numbers(claims)
    if numbers * 8 <= broadcast_bytes:
        parts = _scan_all(_claims(claims), _topics(topics), StatsPerClaim, STATS_SCHEMA)
    else:
        parts = _scan_grid(_claims(claims), _topics(topics), StatsPerClaim, STATS_SCHEMA, n_claims, numbers // n_claims)
    return parts.groupBy("claim_id").agg(
        F.sum("n_topics").alias("n_topics"),
        F.sum("n_positive").alias("n_positive"),
        F.sum("sim_sum").alias("sim_sum"),
        F.max("sim_max").alias("sim_max"),
    )
