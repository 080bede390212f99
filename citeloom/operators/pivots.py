"""Exact nearest topics without looking at every topic.

Topics are grouped around pivots: each belongs to its nearest pivot, and a group knows its
radius, the largest distance of a member from the pivot. For a claim c and a topic t of a
group with pivot p and radius r, c·t = c·p + c·(t - p) <= c·p + |c| r. A group whose bound
is below the claim's k-th best similarity so far holds none of its best topics and is not
looked at. Bounds are rounded up by more than similarities are rounded, and a group is left
out on strict inequality alone, so that ties come out as in a full scan.

Two passes: the first looks at the claim's nearest groups until they hold k topics, which
gives the similarity to beat; the second at all other groups whose bound reaches it. Groups lie
in cells of bounded size, large ones in several. A pass joins claims and topics on the cell: a
claim goes to a cell once, with the list of the cell's groups that it looks at, however many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.similarity import MATCH_SCHEMA, TopicsPerClaim, rows_of_cell, to_matrix, to_singles
from citeloom.session import stage

#: Pivots are a bounded sample: about the root of the number of topics, at most this many.
#: They only guide the search; every topic is in a group.
MOST_PIVOTS = 8192

#: Topics of a cell, and claims that look at it, at most.
CELL_ROWS = 50_000

#: Above the rounding of similarities (9 decimals) and of sums of products of doubles.
MARGIN = 1e-8

_ROWS = 4096


@dataclass
class TopicGroups:
    """``topics``: a stored table ``topic_id, vector, group``; by group: pivot, radius and
    number of members. The latter three are as large as the pivots: bounded."""

    topics: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


@dataclass
class GroupedMatches:
    """``matches``: as of ``topk_topics``. ``visits``: ``claim_id, n_visited, n_groups``."""

    matches: DataFrame
    visits: DataFrame


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return to_matrix(batch.column("vector"))


def group_topics(topics: DataFrame, most_pivots: int = MOST_PIVOTS) -> TopicGroups:
    """``topics``: ``topic_id bigint, vector``; null vectors are left out. Read twice, with one
    sample between; the grouped table can be kept and searched again and again."""
    spark = topics.sparkSession
    topics = topics.where("vector is not null").select("topic_id", F.col("vector").cast("array<float>").alias("vector"))
    n = topics.count()
    wanted = max(1, min(most_pivots, math.isqrt(n)))
    # Equal vectors are one pivot; which rows are taken depends on their ids alone.
    sample = topics.orderBy(F.xxhash64("topic_id"), "topic_id").limit(wanted).toArrow()
    pivots = np.unique(_matrix(sample), axis=0) if sample.num_rows else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        norms = (pivots * pivots).sum(axis=1)
        for batch in batches:
            groups, away = [], []
            vectors = _matrix(batch) if batch.num_rows else np.empty((0, pivots.shape[1]))
            if batch.num_rows and vectors.shape[1] != pivots.shape[1]:
                raise ValueError("topics differ in vector size")
            for at in range(0, len(vectors), _ROWS):
                part = vectors[at : at + _ROWS]
                nearest = np.argmin(norms - 2 * (part @ pivots.T), axis=1)
                groups.append(nearest)
                away.append(np.sqrt(((part - pivots[nearest]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate([np.empty(0, np.int32), *groups]).astype(np.int32)), pa.array(np.concatenate([np.empty(0), *away]))],
                names=["topic_id", "vector", "group", "away"],
            )

    grouped = stage(topics.mapInArrow(assign, "topic_id bigint, vector array<float>, group int, away double"), "topic-groups")
    radius, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for row in grouped.groupBy("group").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():
        radius[row.group], sizes[row.group] = row.radius, row.n
    return TopicGroups(grouped.drop("away"), pivots, radius, sizes)


def _first_groups(near: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """By claim and group, whether it is among the nearest that together hold ``k`` topics."""
    order = np.argsort(-near, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    first = np.zeros(near.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    return first & (sizes > 0)


def visited_share(groups: TopicGroups, claims: DataFrame, k: int, sample: int = 512) -> float:
    """Estimate, from some claims, of the share of topics that claims look at by groups. What a
    claim has to beat is guessed as if the topics of a group were where its pivot is."""
    local = claims.select("claim_id", F.col("vector").cast("array<float>").alias("vector")).orderBy(F.xxhash64("claim_id"), "claim_id").limit(sample).toArrow()
    if not local.num_rows or not groups.sizes.sum():
        return 0.0
    vectors = _matrix(local)
    if vectors.shape[1] != groups.pivots.shape[1]:
        raise ValueError("claims and topics differ in vector size")
    near = vectors @ groups.pivots.T
    floor = np.maximum(0, np.where(_first_groups(near, groups.sizes, k), near, np.inf).min(axis=1))
    visited = near + groups.radius + MARGIN >= floor[:, None]
    return float((visited * groups.sizes).sum() / (len(vectors) * groups.sizes.sum()))


@dataclass
class Cells:
    """By group: its first cell and its number of cells."""

    first: np.ndarray
    parts: np.ndarray


def _lay(sizes: np.ndarray, rows: int) -> Cells:
    """Cells of whole groups, in their order, with ``rows`` topics at most; a larger group has
    cells of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows))
    cell, held = -1, rows
    for group, size in enumerate(sizes.tolist()):
        if cell < 0 or held + size > rows:
            cell, held = cell + 1, 0
        first[group] = cell
        cell, held = cell + int(parts[group]) - 1, held + size
    return Cells(first, parts)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before in one of the keys; the first does."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([key[1:] != key[:-1] for key in keys], axis=0)])


CHOSEN_SCHEMA = "claim_id bigint, vector array<float>, floor double, cells array<int>, groups array<array<int>>"


def _choose(groups: TopicGroups, cells: Cells, claims: DataFrame, k: int, again: bool) -> DataFrame:
    """``claims`` (``claim_id, vector, floor``) with the cells to look at and, for each, the groups
    in it: the first groups of each claim, or, ``again``, those others that may hold a topic as
    near as the claim's ``floor``. A claim without any has no row."""
    shared = claims.sparkSession.sparkContext.broadcast((groups.pivots, groups.radius, groups.sizes, cells.first, cells.parts))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, sizes, first_cell, parts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = _matrix(batch)
                if vectors.shape[1] != pivots.shape[1]:
                    raise ValueError("claims and topics differ in vector size")
                near = vectors @ pivots.T
                picked = _first_groups(near, sizes, k)
                if again:
                    bound = near + np.sqrt((vectors * vectors).sum(axis=1))[:, None] * radius + MARGIN
                    floor = np.asarray(batch.column("floor").to_pylist())
                    picked = ~picked & (sizes > 0) & (bound >= floor[:, None]) & (bound > 0)
                claim, group = np.nonzero(picked)
                # A group in several cells is looked at in each.
                often = parts[group]
                part = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
                claim, group = np.repeat(claim, often), np.repeat(group, often)
                cell = first_cell[group] + part
                order = np.lexsort((group, cell, claim))
                claim, cell, group = claim[order], cell[order], group[order]
                visits = _runs(claim, cell)
                starts = _runs(claim[visits])
                lists = pa.ListArray.from_arrays(np.r_[visits, len(group)].astype(np.int32), pa.array(group.astype(np.int32)))
                offsets = np.r_[starts, len(visits)].astype(np.int32)
                rows = batch.select(["claim_id", "vector", "floor"]).take(pa.array(claim[visits][starts]))
                named = pa.ListArray.from_arrays(offsets, pa.array(cell[visits].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, named, pa.ListArray.from_arrays(offsets, lists)], names=["claim_id", "vector", "floor", "cells", "groups"])

    return claims.select("claim_id", "vector", "floor").mapInArrow(choose, CHOSEN_SCHEMA)


def look_in_cell(claims: pa.Table, topics: pa.Table, k: int) -> pa.Table:
    """Best ``k`` per claim of the cell's groups that the claim names, not below its floor."""
    state = TopicsPerClaim(np.asarray(claims.column("claim_id")), k, np.asarray(claims.column("floor")))
    if claims.num_rows and topics.num_rows:
        own, vectors = to_singles(claims.column("vector")), to_singles(topics.column("vector"))
        ids, member = np.asarray(topics.column("topic_id")), np.asarray(topics.column("group"))
        lists = claims.column("groups").combine_chunks()
        wanted = np.asarray(lists.flatten())
        claim = np.repeat(np.arange(len(own), dtype=np.int32), np.asarray(lists.value_lengths()))
        asked, placed = np.argsort(wanted, kind="stable"), np.argsort(member, kind="stable")
        wanted, claim, member = wanted[asked], claim[asked], member[placed]
        for group in np.unique(member):
            rows = claim[slice(*np.searchsorted(wanted, [group, group + 1]))]
            at = placed[slice(*np.searchsorted(member, [group, group + 1]))]
            if len(rows):
                state.scan(own, ids[at], vectors[at], rows)
    return pa.Table.from_arrays([pa.array(a) for a in state.result()], schema=state.schema)


def _look(groups: TopicGroups, cells: Cells, chosen: DataFrame, k: int, most: int) -> DataFrame:
    """Best ``k`` of the chosen groups per claim and cell: ``claim_id, topic_id, sim``.

    The claims of a cell are dealt to tasks by the thousand, at most ``most`` to one. Where a
    group lies is one row per group, and how its claims are dealt one per cell: bounded, so
    both are broadcast.
    """
    spark = chosen.sparkSession
    asked = {row.cell: row.n for row in chosen.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    rows = rows_of_cell(max(asked.values(), default=0), groups.pivots.shape[1], spark.sparkContext.defaultParallelism, most)
    dealt = F.broadcast(spark.createDataFrame([(cell, -(-n // rows)) for cell, n in sorted(asked.items())], "cell int, deals int"))
    places = [(group, int(first), int(parts)) for group, (first, parts) in enumerate(zip(cells.first, cells.parts, strict=True))]
    placed = F.broadcast(spark.createDataFrame(places, "group int, first int, parts int"))
    left = (
        chosen.select("claim_id", "vector", "floor", F.explode(F.arrays_zip("cells", "groups")).alias("_v"))
        .select("claim_id", "vector", "floor", F.col("_v.cells").alias("cell"), F.col("_v.groups").alias("groups"))
        .join(dealt, "cell")
        .withColumn("deal", F.pmod(F.xxhash64("claim_id"), F.col("deals")).cast("int"))
    )
    right = (
        groups.topics.join(placed, "group")
        .withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("topic_id"), F.col("parts"))).cast("int"))
        .join(dealt, "cell")
        .select("topic_id", "vector", "group", "cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    )

    def look(claims: pa.Table, topics: pa.Table) -> pa.Table:
        return look_in_cell(claims, topics, k)

    cell = ["cell", "deal"]
    return left.drop("deals").groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(look, MATCH_SCHEMA)


def grouped_topk(claims: DataFrame, groups: TopicGroups, k: int, cell_rows: int = CELL_ROWS) -> GroupedMatches:
    """The ``k`` nearest topics per claim with positive similarity, as a full scan finds them.

    ``claims``: ``claim_id bigint, vector``, one row per claim, without null vectors.
    """
    spark = claims.sparkSession
    claims = claims.select("claim_id", F.col("vector").cast("array<float>").alias("vector"))
    n_groups = int((groups.sizes > 0).sum())
    if not n_groups:
        empty = spark.createDataFrame([], MATCH_SCHEMA).withColumn("rank", F.lit(1))
        return GroupedMatches(empty, claims.select("claim_id", F.lit(0).cast("bigint").alias("n_visited"), F.lit(0).alias("n_groups")))
    order = Window.partitionBy("claim_id").orderBy(F.desc("sim"), "topic_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    cells = _lay(groups.sizes, rows_of_cell(int(groups.sizes.sum()), groups.pivots.shape[1], spark.sparkContext.defaultParallelism, cell_rows))
    first = stage(_choose(groups, cells, claims.withColumn("floor", F.lit(0.0)), k, again=False), "first-groups")
    seen = stage(best(_look(groups, cells, first, k, cell_rows)).drop("rank"), "first-matches")
    # Fewer than k positive ones: nothing to beat but zero.
    full = seen.groupBy("claim_id").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = claims.join(full.select("claim_id", "floor"), "claim_id", "left").select("claim_id", "vector", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    second = stage(_choose(groups, cells, floors, k, again=True), "second-groups")
    matches = best(seen.unionByName(_look(groups, cells, second, k, cell_rows)))
    n_visited = F.size(F.array_distinct(F.flatten("groups"))).cast("bigint").alias("n_visited")
    looked = first.select("claim_id", n_visited).unionByName(second.select("claim_id", n_visited)).groupBy("claim_id").agg(F.sum("n_visited").alias("n_visited"))
    return GroupedMatches(matches, looked.withColumn("n_groups", F.lit(n_groups)))
