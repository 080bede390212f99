"""N-gram Jaccard join by grouped prefixes.

Two sets whose Jaccard similarity reaches the threshold share a token among the first few
of each, in any order of all tokens; the rarer the first ones, the fewer candidates. So:

1. Texts with equal sets are one class.
2. Tokens are ordered: a share of all tokens (by hash) comes first, the rarer ones
   earlier; then the others by hash; then a bounded list of very frequent ones. The
   document frequency is counted for that share only: twice what a prefix takes, or half of
   all. Any order is right, it only has to be the same for all.
3. Classes with equal prefixes and size are one group. Only one member stands for it in
   the lists of tokens.
4. A first pass ties neighbours: members to their group, and groups that stand next to
   each other in a token's list. These pairs are verified on the whole texts, and what is
   linked becomes one component. A large group of copies is thus never written as pairs.
   A few rounds more tie components that stand next to each other in a token's list.
5. A second pass takes what is left: pairs of groups that share a token, fit in size and
   are not yet in one component. Pairs are filtered by the number of shared prefix
   tokens, expanded to the members and verified. So no link between components is missed.
6. A token whose list would give more pairs than a few for each set in it is crowded, and
   gives none. Members of its groups are marked by whole cells of their tokens, of which
   similar sets share many (``marks_of``); again only a prefix of them, rarest first, is
   listed. Neighbours in a mark's list are tied first. For what is left, each mark names one
   of its sets as pivot, and sets are compared by what sets them apart from it
   (``differences``): similar sets share one of the rarest of these tokens. A large group of
   texts made from one, each changed elsewhere, so gives no pairs. Nothing is left out: the
   marks find all links between crowded groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import free_name, parts_for, stage
from citeloom.llm.components import components, tie
from citeloom.llm.shingles import mix, shingle_set, shingle_sets
from citeloom.session import broadcast_small

#: Rounds that tie components before the second pass; it is complete after any number. One
#: that links no more than one in ``WORTH`` of its pairs is the last.
BRIDGES = 3
WORTH = 20

#: Most frequent tokens, at most so many, that are ordered last. Looked for among those
#: that at least one in FREQUENT_SHARE of the texts of an Arrow batch have.
FREQUENT = 100_000
FREQUENT_SHARE = 100
FREQUENT_LEAST = 20
SALTS = 64

#: Texts whose tokens or marks a task holds at a time.
SLICE = 200

#: Tokens of one task when their frequencies are counted.
TASK_TOKENS = 1_000_000

#: Partners of one text that one task verifies.
PARTNERS = 1_000

#: Pairs of classes for each class of a token's list, beyond which its sets are marked.
CROWD = 4


def needed(percent: int, sizes: int) -> int:
    """Least intersection of two sets with ``sizes`` elements together:
    100 * i >= percent * (sizes - i)."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def ranked_share(percent: int) -> float:
    """Share of all tokens that are ordered by frequency: twice what a prefix takes, or half."""
    return min(0.5, 2 * (100 - percent) / 100)


def ranked_below(percent: int) -> int:
    """Tokens, as unsigned hashes, below this are ordered by frequency."""
    return (1 << 63) // 100 * min(100, 4 * (100 - percent))


def set_id(tokens: np.ndarray) -> int:
    """64-bit name of a set. Two of ten million sets get the same one by chance with odds
    of one in 300,000."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def read_sets(df: DataFrame, width: int) -> DataFrame:
    """A row for each text (doc_id, said, n, cid), and rows (token, hits) of tokens that
    are frequent in an Arrow batch; staged. ``said`` hashes the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            sizes = [len(s) for s in sets]
            ids = [set_id(s) for s in sets]
            tokens, hits = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            often = hits >= max(FREQUENT_LEAST, len(sets) // FREQUENT_SHARE)
            tokens, hits = signed(tokens[often]), hits[often]
            rows, extra = len(sets), len(tokens)
            none = pa.nulls(extra, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.chunked_array([batch.column(0), none]).combine_chunks(),
                    pa.chunked_array([batch.column(1), none]).combine_chunks(),
                    pa.chunked_array([pa.array(sizes, pa.int64()), none]).combine_chunks(),
                    pa.chunked_array([pa.array(ids, pa.int64()), none]).combine_chunks(),
                    pa.chunked_array([pa.nulls(rows, pa.int64()), pa.array(tokens)]).combine_chunks(),
                    pa.chunked_array([pa.nulls(rows, pa.int64()), pa.array(hits, pa.int64())]).combine_chunks(),
                ],
                names=["doc_id", "said", "n", "cid", "token", "hits"],
            )

    return stage(df.mapInArrow(read, "doc_id bigint, said bigint, n bigint, cid bigint, token bigint, hits bigint"), "sets")


def prefix_candidates(df: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, salt, cid, n, spare): of each set the ranked tokens, and as many of the next
    ones as a prefix may need beyond them. ``spare`` is the prefix length less the number
    of ranked tokens. Frequent tokens are salted by the set. A task writes a set once."""

    below = ranked_below(percent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for tokens in shingle_sets(batch.column(2).to_pylist(), width):
                n = len(tokens)
                if not n:
                    continue
                cid = set_id(tokens)
                if cid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(cid)
                often = np.isin(tokens, frequent, assume_unique=True)
                ranked = tokens[~often & (tokens < below)]
                spare = prefix_length(n, percent) - len(ranked)
                others = tokens[~often & (tokens >= below)][: max(0, spare)]
                last = tokens[often][: max(0, spare - len(others))]
                taken = signed(np.concatenate([ranked, others, last]))
                salts = np.zeros(len(taken), np.int32)
                salts[len(taken) - len(last) :] = 1 + cid % SALTS
                for part, values in zip(out, (taken, salts, np.full(len(taken), cid), np.full(len(taken), n), np.full(len(taken), spare)), strict=True):
                    part.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(p), t) for p, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["token", "salt", "cid", "n", "spare"],
                )

    return df.mapInArrow(read, "token bigint, salt int, cid bigint, n bigint, spare bigint")


def shared_tokens(found: DataFrame, partitions: int) -> DataFrame:
    """Rows of tokens that more than one set has, with ``hits``, the number of sets; repeats
    of (token, cid) once. Salted tokens are kept as they are, with null hits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def closed(rows: np.ndarray) -> pa.RecordBatch:
            """Rows (token, salt, cid, n, spare) of whole runs."""
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            rows = rows[new]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            run = np.cumsum(first) - 1
            hits = np.bincount(run, minlength=1)[run] if len(rows) else np.zeros(0, np.int64)
            keep = (hits > 1) | (rows[:, 1] > 0)
            rows, hits = rows[keep], hits[keep]
            shown = pa.array(hits, pa.int64(), mask=rows[:, 1] > 0)
            columns = [pa.array(rows[:, i]) for i in (0, 2, 3, 4)]
            return pa.RecordBatch.from_arrays([columns[0], pa.array(rows[:, 1].astype(np.int32)), *columns[1:], shown], names=["token", "salt", "cid", "n", "spare", "hits"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            held.append(rows)
            # The last run may go on in the next batch.
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            if len(last) or (held[0][0, :2] != rows[-1, :2]).any():
                cut = int(last[-1]) + 1 if len(last) else 0
                whole = np.concatenate([*held[:-1], rows[:cut]])
                held = [rows[cut:]]
                if len(whole):
                    yield closed(whole)
        if held:
            yield closed(np.concatenate(held))

    placed = found.repartition(partitions, "token", "salt").sortWithinPartitions("token", "salt", "cid")
    return placed.mapInArrow(count, "token bigint, salt int, cid bigint, n bigint, spare bigint, hits bigint")


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, salt, cid, n, place): the tokens of each prefix that another set has; (place,
    token) is the order of all tokens."""
    own = Window.partitionBy("cid")
    ranked = F.col("hits").isNotNull() & (F.col("token") >= 0) & (F.col("token") < ranked_below(percent))
    counted = (
        shared.withColumn("_ranked", ranked)
        .withColumn("_shared", F.sum(F.col("_ranked").cast("int")).over(own))
        .withColumn("_place", F.row_number().over(own.orderBy(F.desc("_ranked"), "hits", "token")))
    )
    kept = counted.where(~F.col("_ranked") | (F.col("_place") <= F.col("_shared") + F.col("spare")))
    place = F.when(F.col("_ranked"), F.col("hits")).otherwise(F.lit(1 << 40) * (1 + F.signum(F.col("salt"))))
    return kept.select("token", "salt", "cid", "n", place.cast("bigint").alias("place"))


def prefix_size(n, percent: int):
    return n - F.ceil(n * percent / 100.0) + 1


def size_class(n, percent: int):
    """Sets of a class and the next one may be similar, others may not."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int")


def beside_each_other(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text): for pairs (a, b) of set ids the text of ``a``, with a null ``b``, and after it
    the texts of its partners. A text with very many partners is sent to several tasks."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("_tasks"))
    placed = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_tasks")).cast("int").alias("_task"))
    second = placed.join(texts.select(F.col("cid").alias("b"), "text"), "b").select("a", "_task", "b", "text")
    first = (
        texts.select(F.col("cid").alias("a"), "text")
        .join(spread, "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"), F.lit(None).cast("bigint").alias("b"), "text")
    )
    return (
        first.unionByName(second)
        .repartition("a", "_task")
        .sortWithinPartitions("a", "_task", F.col("b").asc_nulls_first())
        .select("a", "b", "text")
    )


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar enough, by their whole texts.
    Rows are streamed: one set is held at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            for a, b, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                if b is None:
                    base = tokens
                elif percent * (len(base) + len(tokens)) <= (100 + percent) * len(np.intersect1d(base, tokens, assume_unique=True)):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return beside_each_other(pairs, texts).mapInArrow(compare, "a bigint, b bigint")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the classes that occur in ``wanted``, staged."""
    ids = wanted.select(F.col("a").alias("cid")).unionByName(wanted.select(F.col("b").alias("cid"))).distinct()
    slim = classes.join(ids, "cid", "left_semi").select("cid", F.col("first.doc_id").alias("doc_id"), F.col("first.said").alias("said"))
    slim = broadcast_small(stage(slim, "wanted"))
    on = docs["said"].eqNullSafe(slim["said"]) & docs["doc_id"].eqNullSafe(slim["doc_id"])
    return stage(docs.join(slim, on).select("cid", "text").dropDuplicates(["cid"]), "texts")


def join_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85
) -> DataFrame:
    """doc_id, said, n_shingles, component_id, first_of_component of every row.

    A document's set has the distinct shingles of ``width`` words, A-Z lower-cased; with
    fewer words the whole sequence is one. Two are linked if 100 * intersection >=
    ``percent`` * union. ``component_id`` is the least id that links reach. A null text, or
    one without words, has no shingles and is its own component. Repeated rows each have
    their row; a null id counts for no component. An empty table gives no rows; other
    columns are not read. ``said`` is a hash of the text; ``first_of_component`` marks the
    least (id, said) of a component, and every text without shingles.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("said"), F.col(text).alias("text"))
    staged = read_sets(docs, width)
    sets = staged.where("n is not null")
    frequent = (
        staged.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "token").limit(FREQUENT).select("token").collect()
    )
    frequent = np.array([r.token for r in frequent], np.int64).view(np.uint64)
    classes = sets.where("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "said")).alias("first"), F.min("doc_id").alias("low"), F.first("n").alias("n"))
    classes = stage(classes, "classes")
    tokens = classes.agg(F.sum("n")).first()[0] or 0

    found = prefix_candidates(docs, width, percent, np.sort(frequent))
    own = stage(prefixes(shared_tokens(found, parts_for(tokens * ranked_share(percent), TASK_TOKENS, spark)), percent), "prefixes")

    # Groups of equal prefix and size. A prefix with tokens that no other set has is alone.
    kinds = own.groupBy("cid").agg(
        F.first("n").alias("n"),
        F.count("*").alias("_tokens"),
        F.sum(F.xxhash64("token").cast("decimal(20,0)")).alias("_sum"),
        F.max(F.struct("place", "token")).alias("last"),
    )
    kinds = kinds.withColumn("_whole", F.col("_tokens") == prefix_size(F.col("n"), percent))
    kinds = kinds.withColumn("_alone", F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("cid")))
    same = ["n", "_tokens", "_sum", "_whole", "_alone"]
    leaders = kinds.groupBy(*same).agg(F.min("cid").alias("gid"))
    members = stage(kinds.join(leaders, same).select("cid", "gid", "n", "last", F.col("_tokens").alias("tokens")), "members")
    lists = stage(
        own.withColumnRenamed("cid", "gid").join(members.where("cid = gid").select("gid", "tokens", "last"), "gid").select("token", "salt", "gid", "n", "tokens", "last"), "lists"
    )

    # First pass: neighbours.
    beside = Window.partitionBy("token", "salt", size_class(F.col("n"), percent)).orderBy("n", "gid")
    chain = lists.select(F.lag("gid").over(beside).alias("a"), F.col("gid").alias("b")).where("a is not null")
    near = chain.unionByName(members.where("cid != gid").select(F.col("gid").alias("a"), F.col("cid").alias("b")))
    near = stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "near")
    links = stage(verify(near, texts_of(docs, classes, near), width, percent), "links")
    roots = stage(components(links), "roots")

    for _ in range(BRIDGES):
        rooted = place(members, lists, roots)
        pairs = stage(bridges(rooted, percent), "bridges")
        new = stage(verify(pairs, texts_of(docs, classes, pairs), width, percent), "new-links")
        roots = tie(roots, new)
        if new.count() * WORTH <= pairs.count():
            break

    # Second pass: what is not in one component yet.
    rooted = place(members, lists, roots)
    crowded = stage(crowds(rooted), "crowds")
    far = stage(short_lists(rooted, crowded, members, roots, percent), "far")
    roots = tie(roots, stage(verify(far, texts_of(docs, classes, far), width, percent), "more-links"))
    named = members.join(in_crowds(rooted, crowded), "gid", "left_semi").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    texts = texts_of(docs, classes, named)
    marks = stage(shared_marks(texts, width, percent, parts_for(tokens * 0.4, TASK_TOKENS, spark)), "marks")
    for _ in range(BRIDGES):
        pairs = stage(mark_neighbours(marks, roots), "mark-bridges")
        new = stage(verify(pairs, texts, width, percent), "mark-links")
        roots = tie(roots, new)
        if new.count() * WORTH <= pairs.count():
            break
    apart = stage(differences(mark_pivots(marks, roots), texts, width, percent), "apart")
    roots = tie(roots, apart.where("token is null").select("a", "b"))
    left = stage(pairs_by_differences(apart.where("token is not null"), roots, percent), "left")
    roots = tie(roots, stage(verify(left, texts, width, percent), "last-links"))

    final = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "low", "first", F.coalesce("root", "cid").alias("root"))
    final = stage(final, "final")
    lowest = final.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("_first"))
    by_class = final.join(lowest, "root").select(F.col("cid").alias("_cid"), "component_id", "_first")
    return sets.join(by_class, sets["cid"] == F.col("_cid"), "left").select(
        "doc_id",
        "said",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("_first").isNull() | (F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & F.col("_first.said").eqNullSafe(F.col("said")))).alias("first_of_component"),
    )


def place(members: DataFrame, lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with the component of each group: ``one``, or if its members are in
    several, 0 and ``mixed``, the group; and ``weight``, the number of its members."""
    spans = (
        with_roots(members, roots).groupBy("gid").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("weight"))
    )
    same = F.col("_low") == F.col("_high")
    who = spans.select("gid", F.when(same, F.col("_low")).otherwise(0).alias("one"), F.when(~same, F.col("gid")).otherwise(0).alias("mixed"), "weight")
    return stage(lists.join(who, "gid"), "rooted")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of ``cid``, ``root``; a class without links is its own."""
    return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def bridges(rooted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups of different components, next to each other in the list of a
    token. Component and member are taken in an order of the token's own, so that each
    token ties others."""
    one = rooted.groupBy("token", "one", "mixed").agg(F.min(F.struct(F.xxhash64("token", "gid"), "gid", "n")).alias("_some"))
    beside = Window.partitionBy("token", size_class(F.col("_some.n"), percent)).orderBy(F.xxhash64("token", "one", "mixed"), "one", "mixed")
    found = one.select(F.lag("_some").over(beside).alias("_before"), F.col("_some")).where("_before is not null")
    a, b = F.col("_before.gid"), F.col("_some.gid")
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def crowds(rooted: DataFrame) -> DataFrame:
    """(token, crowded) of the tokens whose sets are in more than one component.

    A token is crowded if its list has more than CROWD pairs of classes of different
    components for each class in it. The pairs are counted, not made: the square of all
    less the squares of each component.
    """
    parts = rooted.groupBy("token", "one", "mixed").agg(F.sum("weight").cast("double").alias("_w"))
    tokens = parts.groupBy("token").agg(F.count("*").alias("_parts"), F.sum("_w").alias("_all"), F.sum(F.col("_w") * F.col("_w")).alias("_same"))
    return tokens.where("_parts > 1").select("token", (F.col("_all") * F.col("_all") - F.col("_same") > 2 * CROWD * F.col("_all")).alias("crowded"))


def in_crowds(rooted: DataFrame, crowded: DataFrame) -> DataFrame:
    """(gid) of groups with a crowded token, and of those whose members are in several
    components."""
    met = rooted.join(crowded.where("crowded").select("token"), "token", "left_semi").select("gid")
    return met.unionByName(rooted.where("mixed != 0").select("gid")).distinct()


def short_lists(rooted: DataFrame, crowded: DataFrame, members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that the prefixes allow, from the
    tokens that are not crowded: at most CROWD for each row of the lists.

    Two groups that also share a crowded token may be left out here, as their count of
    shared tokens is too low; they are found by their marks.
    """
    few = rooted.join(crowded.where("not crowded").select("token"), "token", "left_semi").select(
        "token", F.struct("one", "mixed").alias("part"), "gid", F.struct("n", "tokens", "last").alias("s")
    )
    a, b = few.alias("a"), few.alias("b")
    fits = (F.col("a.s.n") * percent <= F.col("b.s.n") * 100) & (F.col("b.s.n") * percent <= F.col("a.s.n") * 100)
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.part") != F.col("b.part")) & (F.col("a.gid") < F.col("b.gid")) & fits)
    groups = (
        met.select(F.col("a.gid").alias("x"), F.col("b.gid").alias("y"), F.col("a.s").alias("sx"), F.col("b.s").alias("sy"))
        .groupBy("x", "y")
        .agg(F.count("*").alias("shared"), F.max("sx").alias("sx"), F.max("sy").alias("sy"))
        .where(may_be_similar(percent))
        .select("x", "y")
    )
    placed = with_roots(members.select("cid", "gid"), roots)
    p = placed.select(F.col("gid").alias("x"), F.col("cid").alias("a"), F.col("root").alias("_ra"))
    q = placed.select(F.col("gid").alias("y"), F.col("cid").alias("b"), F.col("root").alias("_rb"))
    return groups.join(p, "x").join(q, "y").where("_ra != _rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cells_at(kind: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sets of a size class, or of it and the next one: the number of cells
    that tokens are dealt to, and how many tokens similar sets may differ in."""
    # One more than the largest size covers the rounding of the logarithms.
    most = np.floor((100 / percent) ** (kind + 1.0)) + 1
    differ = np.floor((100 - percent) * (most + np.floor(most * 100 / percent)) / (100 + percent)).astype(np.int64)
    return np.maximum(differ + 1, 2 * differ), differ


def marks_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which set, mark, level, room): similar sets share a mark of the same level.

    Sets of one size class, or of a class and the next one, that are similar differ in
    ``d`` tokens at most. Their tokens are dealt by hash to about 2 d cells; all cells but
    d hold the same tokens in both. The mark of a cell that is not empty is its hash. Two
    sets, one of them with more than d marks, then share one among the first d + 1 of
    each, in any order of all marks. ``room`` is d + 1 less the number of the set's marks.
    A set with d marks or fewer is marked by its first tokens as well, in a level of their
    own and all of them wanted: two such sets share one. A set is marked for its own size
    class and for the one below.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    whole = np.flatnonzero(sizes)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, tokens = sizes[whole], np.concatenate([sets[i] for i in whole])
    kinds = np.floor(np.log(sizes) / math.log(100 / percent) + 1e-9).astype(np.int64)
    stirred = mix(tokens + np.uint64(0x632BE59BD9B4E019))
    out: list[list[np.ndarray]] = [[], [], [], []]

    def add(*columns: np.ndarray) -> None:
        for part, values in zip(out, columns, strict=True):
            part.append(values)

    for kind in (kinds, kinds - 1):
        cells, differ = cells_at(kind, percent)
        offset = np.cumsum(cells) - cells
        at = np.repeat(offset, sizes) + (stirred % np.repeat(cells, sizes).astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(total, at, mix(tokens))
        filled = np.bincount(at, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(whole)), cells)
        place = np.arange(len(total)) - offset[owner]
        salt = mix(kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        marks = mix(total + salt[owner] + mix(place.astype(np.uint64) + np.uint64(7)))
        held = np.bincount(owner[filled], minlength=len(whole))
        room = differ + 1 - held
        add(owner[filled], marks[filled], 2 * kind[owner[filled]], room[owner[filled]])
        for i in np.flatnonzero(held <= differ):
            first = sets[whole[i]][: prefix_length(int(sizes[i]), percent)]
            add(np.full(len(first), i), mix(first ^ salt[i]), np.full(len(first), 2 * kind[i] + 1), np.full(len(first), 1 << 40))
    which, marks, level, room = (np.concatenate(part) for part in out)
    return whole[which], marks, level, room


def shared_marks(texts: DataFrame, width: int, percent: int, partitions: int) -> DataFrame:
    """(mark, cid) of the marks that other classes have as well, of each class and level
    only the rarest that ``room`` leaves: marks that no other class has come first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids = batch.column(0).to_numpy()
            which, marks, level, room = marks_of(shingle_sets(batch.column(1).to_pylist(), width), percent)
            yield pa.RecordBatch.from_arrays([pa.array(signed(marks)), pa.array(ids[which]), pa.array(level), pa.array(room)], names=["mark", "cid", "level", "room"])

    found = texts.select("cid", "text").mapInArrow(read, "mark bigint, cid bigint, level bigint, room bigint").repartition(partitions, "mark")
    common = found.withColumn("_hits", F.count("*").over(Window.partitionBy("mark"))).where("_hits > 1")
    own = Window.partitionBy("cid", "level")
    placed = common.withColumn("_shared", F.count("*").over(own)).withColumn("_place", F.row_number().over(own.orderBy("_hits", "mark")))
    return placed.where("_place <= room + _shared").select("mark", "cid")


def mark_neighbours(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, one of each component that has a mark, next to each other
    in the mark's own order."""
    one = with_roots(marks, roots).groupBy("mark", "root").agg(F.min(F.struct(F.xxhash64("mark", "cid"), "cid")).alias("_some"))
    beside = Window.partitionBy("mark").orderBy(F.xxhash64("mark", "root"), "root")
    found = one.select(F.lag("_some.cid").over(beside).alias("x"), F.col("_some.cid").alias("y")).where("x is not null")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def mark_pivots(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): for each class ``b`` the pivot of each of its marks that classes of different
    components have, the class with the most such marks, so that a group has few pivots."""
    rooted = with_roots(marks, roots)
    spans = rooted.groupBy("mark").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high").select("mark")
    open_marks = stage(rooted.join(spans, "mark", "left_semi").select("mark", "cid"), "open-marks")
    counted = open_marks.join(open_marks.groupBy("cid").agg(F.count("*").alias("_marks")), "cid")
    pivots = counted.groupBy("mark").agg(F.max(F.struct("_marks", F.xxhash64("cid"), "cid"))["cid"].alias("a"))
    return stage(open_marks.join(pivots, "mark").where("a != cid").select("a", F.col("cid").alias("b")).distinct(), "pivots")


def differences(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, n, apart, token): the tokens that only one of the sets of a pair has, their
    number and the size of ``b``. A pair that is similar has a row without a token too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            for a, b, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                if b is None:
                    base = tokens
                    continue
                found = signed(np.setxor1d(base, tokens, assume_unique=True))
                n, size = len(tokens), len(found)
                linked = (100 + percent) * size <= (100 - percent) * (len(base) + n)
                rows = size + linked
                # The first row stands for the link.
                for part, values in zip(out, (np.full(rows, a), np.full(rows, b), np.full(rows, n), np.full(rows, size), np.concatenate([found[:0], *([[0]] * linked), found])), strict=True):
                    part.append(values.astype(np.int64))
                out[4][-1] = pa.array(out[4][-1], mask=np.arange(rows) < linked)
            if out[0]:
                tokens = pa.chunked_array(out[4], pa.int64()).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(p)) for p in out[:4]), tokens], names=["a", "b", "n", "apart", "token"])

    return beside_each_other(pairs, texts).mapInArrow(compare, "a bigint, b bigint, n bigint, apart bigint, token bigint")


def pairs_by_differences(apart: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may be similar, of those with a
    pivot in common.

    What only one of two sets has is what only one of their differences from the pivot has.
    So similar sets of n and m tokens, whose differences have x and y, share
    (x + y - (n + m) * (100 - percent) / (100 + percent)) / 2 tokens of these at least, and
    one among the first of each, in any order: here the rarest of the pivot's come first. If
    that is none, both are similar to the pivot, thus in one component.
    """
    common = apart.withColumn("_hits", F.count("*").over(Window.partitionBy("a", "token"))).where("_hits > 1")
    own = Window.partitionBy("a", "b")
    placed = common.withColumn("before", F.col("apart") - F.count("*").over(own) + F.row_number().over(own.orderBy("_hits", "token")) - 1)
    few = placed.where(F.col("before") * percent <= F.col("n") * (100 - percent)).select(F.col("a").alias("pivot"), "token", F.col("b").alias("cid"), "n", "apart", "before")
    few = stage(with_roots(few, roots), "differences")
    p, q = few.alias("p"), few.alias("q")
    most = (F.col("p.n") + F.col("q.n")) * (100 - percent)
    more = (F.col("p.apart") - F.col("q.apart")) * (100 + percent)
    fits = (F.col("p.before") * 2 * (100 + percent) <= most + more) & (F.col("q.before") * 2 * (100 + percent) <= most - more)
    met = p.join(q, (F.col("p.pivot") == F.col("q.pivot")) & (F.col("p.token") == F.col("q.token")) & (F.col("p.root") < F.col("q.root")) & fits)
    return met.select(F.least("p.cid", "q.cid").alias("a"), F.greatest("p.cid", "q.cid").alias("b")).distinct()


def may_be_similar(percent: int):
    """Whether two sets with ``shared`` tokens in both prefixes can reach the threshold.

    Up to the end of the prefix that ends first, all common tokens are shared; behind it
    there are the rest of that set. Nor can the tokens be common that no other set has.
    """
    n_x, n_y = F.col("sx.n"), F.col("sy.n")
    rest_x, rest_y = n_x - prefix_size(n_x, percent), n_y - prefix_size(n_y, percent)
    rest = (
        F.when(F.col("sx.last") < F.col("sy.last"), rest_x).when(F.col("sy.last") < F.col("sx.last"), rest_y).otherwise(F.least(rest_x, rest_y))
    )
    most = F.least(F.col("shared") + rest, rest_x + F.col("sx.tokens"), rest_y + F.col("sy.tokens"))
    return most * (100 + percent) >= (n_x + n_y) * percent


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one document of each component, with their columns: the one
    with the least id. Of rows that repeat id and text one stays; documents without
    shingles all stay.

    Only the rows to drop and the repeated ones are looked up, by id and a hash of the
    text; texts are not shuffled while those are few.
    """
    columns = df.columns
    found = stage(join_components(df, key, text, **options), "components")
    keys = found.groupBy("doc_id", "said").agg(F.count("*").alias("copies"), F.first("first_of_component").alias("first"), F.first("n_shingles").alias("n"))
    own, k, s, first = (free_name(df, name) for name in ("_own", "_k", "_s", "_first"))
    special = keys.where("not first or (copies > 1 and n > 0)").select(F.col("doc_id").alias(k), F.col("said").alias(s), F.col("first").alias(first))
    special = broadcast_small(stage(special, "special"))
    said = df.withColumn(own, F.xxhash64(F.col(text)))
    joined = said.join(special, F.col(key).cast("bigint").eqNullSafe(F.col(k)) & (F.col(own) == F.col(s)), "left")
    plain = joined.where(F.col(first).isNull()).select(*columns)
    once = joined.where(F.col(first)).dropDuplicates([key, own]).select(*columns)
    return plain.unionByName(once)
