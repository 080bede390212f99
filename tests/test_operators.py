"""Operators against brute force on small fixtures, with hot keys and ties."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from citeloom.operators import models, similarity
from citeloom.operators.models import HashingEncoder, OverlapScorer, embed_column, run_with_retries, support_score, topic_embed
from citeloom.operators.ordered import assign_ids, read_with_ids, with_next, with_running_total
from citeloom.operators.pivots import _choose, _lay, group_topics, grouped_topk, visited_share
from citeloom.operators.quality import check_citation_fk, check_types, check_unique_name
from citeloom.operators.similarity import TopicsPerClaim, claim_topic_sim, topk_topics
from citeloom.operators.skew import salted_join
from citeloom.operators.support import claim_premise_pairs, score_pairs, split_claims, support_nested
from citeloom.session import scratch_path, stage
from citeloom.sources.colocated import colocated_citations, read_colocated, write_colocated


def vectors(spark, ids, matrix, name):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>").repartition(5)


def unit(rng, n, size=16):
    m = rng.normal(size=(n, size)).astype(np.float32)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 2000])
def test_topk_is_brute_force(spark, broadcast_bytes):
    """A third of the topics are copies of one vector; both ways of sharing the work."""
    rng = np.random.default_rng(1)
    claims, topics = unit(rng, 40), unit(rng, 300)
    topics[rng.permutation(300)[:100]] = topics[7]
    claims[3] = topics[7]
    got = topk_topics(vectors(spark, range(40), claims, "claim_id"), vectors(spark, range(300), topics, "topic_id"), 5, broadcast_bytes)
    rows = sorted((r["claim_id"], r["rank"], r["topic_id"]) for r in got.collect())
    expected = []
    for c in range(40):
        sims = [(-round(float(claims[c].astype(float) @ t.astype(float)), 9), i) for i, t in enumerate(topics)]
        best = [s for s in sorted(sims) if s[0] < 0][:5]
        expected += [(c, rank + 1, i) for rank, (_, i) in enumerate(best)]
    assert rows == sorted(expected)
    assert not topk_topics(vectors(spark, range(40), claims, "claim_id"), vectors(spark, [], [], "topic_id"), 5, broadcast_bytes).count()


def test_groups_skip_and_agree_with_the_scan(spark):
    """Clustered topics with ties across groups: the same rows, most groups left out; a third
    of the topics are one vector, cut into cells."""
    rng = np.random.default_rng(8)
    centres = unit(rng, 12, 32)

    def around(n):
        m = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.05, size=(n, 32))
        return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)

    topics, claims = around(900), around(150)
    topics[rng.permutation(900)[:300]] = topics[5]
    claims[:20], claims[20] = topics[:20], -centres[0]
    c, t = vectors(spark, range(150), claims, "claim_id"), vectors(spark, rng.permutation(900), topics, "topic_id")
    found = grouped_topk(c, group_topics(t), 5, cell_rows=64)
    columns = ["claim_id", "topic_id", "sim", "rank"]
    assert sorted(map(tuple, found.matches.select(columns).collect())) == sorted(map(tuple, topk_topics(c, t).select(columns).collect()))
    visits = found.visits.agg(F.sum("n_visited"), F.sum("n_groups"), F.count("*"), F.max(F.col("n_visited") > F.col("n_groups"))).first()
    assert visits[2] == 150 and not visits[3]
    assert visits[0] < 0.5 * visits[1]


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_many_claims_are_grouped_only_where_groups_are_left_out(spark, monkeypatch):
    """More claims than one broadcast takes: in rounds where every group would be looked at, and
    never in more than ``MOST_ROUNDS``; the rows of brute force either way, with many parts."""
    monkeypatch.setattr(similarity, "PART_CLAIMS", 10)
    rng = np.random.default_rng(11)
    claims, topics = unit(rng, 100, 32), unit(rng, 400, 32)
    centres = unit(rng, 6, 32)
    near = centres[rng.integers(0, 6, 400)] + rng.normal(scale=0.02, size=(400, 32))
    clustered = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    claims[:5], clustered[10:20] = topics[:5], clustered[9]
    for which, own, limit, grouped in ((topics, claims, 12_000, False), (clustered, clustered[:100], 12_000, True), (topics, claims, 2_000, True)):
        c, t = vectors(spark, range(100), own, "claim_id"), vectors(spark, range(400), which, "topic_id")
        share = visited_share(group_topics(t), c, 5)
        assert share < 0.2 if which is clustered else share > 0.8
        found = topk_topics(c, t, 5, limit)
        assert ("CoGroups" in plan_of(found)) == grouped
        sims = np.round(own.astype(float) @ which.astype(float).T, 9)
        want = [(i, int(j), n + 1) for i in range(100) for n, j in enumerate(np.lexsort((range(400), -sims[i]))[:5]) if sims[i][j] > 0]
        assert sorted((r.claim_id, r.topic_id, r["rank"]) for r in found.collect()) == sorted(want)


def test_many_claims_are_broadcast_in_parts(spark, monkeypatch):
    """A partition of topics is no bound for the tasks, and a claim gets its best from few of them."""
    monkeypatch.setattr(similarity, "PART_CLAIMS", 20)
    rng = np.random.default_rng(12)
    claims, topics = unit(rng, 200), unit(rng, 300)
    scanned = []
    scan = similarity._scan_all

    def spied(*args):
        scanned.append(scan(*args))
        return scanned[-1]

    monkeypatch.setattr(similarity, "_scan_all", spied)
    c, t = vectors(spark, range(200), claims, "claim_id"), vectors(spark, range(300), topics, "topic_id")
    found = topk_topics(c, t.coalesce(1), 5)
    assert plan_of(scanned[0]).count("MapInArrow") == 10 and found.count() == 1000
    assert topk_topics(c, t.repartition(30), 5).count() == 1000
    assert scanned[1].groupBy("claim_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 5 * 2


def test_grid_cells_do_not_go_by_the_broadcast_limit(spark):
    """A low limit for broadcasts chooses the grid; it must not copy the topics to a cell for
    every few claims."""
    rng = np.random.default_rng(3)
    claims, topics = unit(rng, 300), unit(rng, 200)
    stats = claim_topic_sim(vectors(spark, range(300), claims, "claim_id"), vectors(spark, range(200), topics, "topic_id"), broadcast_bytes=1000)
    copies = [int(n) for n in re.findall(r"sequence\(0, (\d+)", stats._jdf.queryExecution().analyzed().toString())]
    assert len(copies) == 2 and max(copies) == 0
    sims = np.round(claims.astype(float) @ topics.astype(float).T, 9)
    got = {r.claim_id: (r.n_topics, r.n_positive, round(r.sim_sum, 6), r.sim_max) for r in stats.collect()}
    assert got == {c: (200, (sims[c] > 0).sum(), round(sims[c].sum(), 6), sims[c].max()) for c in range(300)}


@pytest.mark.parametrize("rows", [None, np.arange(0, 1300, 3)])
def test_double_precision_decides_and_only_near_the_best(monkeypatch, rows):
    """Similarities that single precision cannot tell apart, copies, opposite vectors."""
    rng = np.random.default_rng(4)
    claims, topics = unit(rng, 1300), unit(rng, 9000)
    topics[100:140] = claims[9]
    topics[200:240] = claims[9] + np.float32(1e-7) * rng.normal(size=(40, 16)).astype(np.float32)
    topics[3000:3040] = topics[7000]
    claims[12] = -topics[7000]
    looked = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: looked.append(len(a)) or einsum(how, a, b))
    ids = rng.permutation(9000)
    state = TopicsPerClaim(np.arange(1300), 5)
    state.scan(claims, ids, topics, rows)
    claim, topic, sim = state.result()
    assert sum(looked) < 0.05 * 1300 * 9000
    exact = np.round(claims.astype(float) @ topics.astype(float).T, 9)
    for c in range(1300) if rows is None else rows:
        order = np.lexsort((ids, -exact[c]))[:5]
        assert sorted(topic[claim == c]) == sorted(ids[order])
        assert np.allclose(np.sort(sim[claim == c]), np.sort(exact[c][order]), atol=2e-9)
    assert len(claim) == 5 * (1300 if rows is None else len(rows))


def test_a_claim_goes_to_a_cell_once(spark):
    """However many of a cell's groups it looks at; a group in several cells is looked at in each."""
    rng = np.random.default_rng(5)
    c, topics = vectors(spark, range(30), unit(rng, 30), "claim_id"), unit(rng, 200)
    topics[:80] = topics[0]
    groups = group_topics(vectors(spark, range(200), topics, "topic_id"))
    cells = _lay(groups.sizes, 60)
    chosen = _choose(groups, cells, c.withColumn("floor", F.lit(0.0)), 150, again=False).collect()
    large = int(groups.sizes.argmax())
    assert cells.parts[large] == 2 and len(chosen) == 30
    for row in chosen:
        assert len(set(row.cells)) == len(row.cells) == len(row.groups)
        assert sum(large in names for names in row.groups) in (0, 2)
        assert all(cells.first[g] <= cell < cells.first[g] + cells.parts[g] for cell, names in zip(row.cells, row.groups) for g in names)
    assert max(len(names) for row in chosen for names in row.groups) > 1


def test_topk_ties_and_signs(spark):
    topics = vectors(spark, [9, 4, 2], [[0.5, 0.75**0.5] + [0] * 6, [0.5, -(0.75**0.5)] + [0] * 6, [-1] + [0] * 7], "topic_id")
    claims = vectors(spark, [1], [[1] + [0] * 7], "claim_id")
    assert [tuple(r) for r in topk_topics(claims, topics, 1).select("topic_id", "rank").collect()] == [(4, 1)]
    assert {r["topic_id"] for r in topk_topics(claims, topics, 5).collect()} == {9, 4}
    stats = claim_topic_sim(claims, topics).first()
    assert (stats["n_topics"], stats["n_positive"], round(stats["sim_sum"], 6)) == (3, 2, 0.0)


def test_bad_vectors_stop_the_job(spark):
    claims = vectors(spark, [1], [[1] + [0] * 7], "claim_id")
    for bad in ([[2.0] + [0] * 7], [[1.0] + [0] * 6]):
        with pytest.raises(PythonException):
            topk_topics(claims, vectors(spark, [1], bad, "topic_id")).collect()


@pytest.mark.parametrize("large_rows", [10_000, 30])
def test_colocated_join_moves_no_text(spark, large_rows):
    """A third of the citations are of one topic, a third of the matches of another."""
    rng = random.Random(4)
    cites = [(rng.choice([7, *range(40)]) if i % 3 else 7, i, f"u{i}", f"said {i}") for i in range(600)]
    matches = [(i, rng.randrange(45) if i % 3 else 9, 0.5, 1) for i in range(200)]
    topics = spark.createDataFrame([(i, f"t{i}") for i in range(42)], "topic_id bigint, name string")
    path = scratch_path(spark, "colocated")
    write_colocated(topics, spark.createDataFrame(cites, "topic_id bigint, citation_id bigint, uri string, sentence string"), path, 6, large_rows)
    tables = read_colocated(spark, path)
    assert (tables.large.count() > 0) == (large_rows == 30)
    asked = stage(spark.createDataFrame(matches, "claim_id bigint, topic_id bigint, sim double, rank int"), "matches")
    expected = sorted((c, t, f"t{t}", i, u, said) for c, t, *_ in matches for t2, i, u, said in cites if t == t2 and t < 42)
    for hot_rows in (10_000, 20):
        got = colocated_citations(asked, tables, hot_rows)
        assert sorted(tuple(r) for r in got.select("claim_id", "topic_id", "name", "citation_id", "uri", "sentence").collect()) == expected
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.citations.join(asked.join(tables.topics, "topic_id"), "topic_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The matches are the only side that is moved.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    with pytest.raises(ValueError, match="no finished layout"):
        read_colocated(spark, path + "-other")


@pytest.mark.parametrize("small_bytes", [1 << 20, 0])
def test_ordered(spark, small_bytes):
    random.seed(3)
    values = random.sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 17) for v in values], "k bigint, n bigint").repartition(6)
    order = sorted(values)
    ids = {r["k"]: r["i"] for r in assign_ids(df, "i", 50, ["k"], small_bytes).collect()}
    assert ids == {v: 51 + at for at, v in enumerate(order)}
    scan = [r["i"] for r in assign_ids(df, "i", 50).collect()]
    assert sorted(scan) == list(range(51, 751))
    nexts = {r["k"]: r["after"] for r in with_next(df, ["k"], "k", "after", small_bytes).collect()}
    assert nexts == dict(zip(order, order[1:] + [None]))
    sums = {r["k"]: r["s"] for r in with_running_total(df, ["k"], "n", "s", small_bytes).collect()}
    total = 0
    for v in order:
        assert sums[v] == total
        total += v % 17


def test_ordered_spans_partitions(spark):
    """Without adaptive coalescing the rows really lie in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        test_ordered(spark, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_read_with_ids(spark):
    path = scratch_path(spark, "rows")
    spark.range(1000).repartition(7).write.parquet(path)
    first = {r["id"]: r["n"] for r in read_with_ids(spark, path, "n", 10).collect()}
    assert sorted(first.values()) == list(range(11, 1011))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert {r["id"]: r["n"] for r in read_with_ids(spark, path, "n", 10).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_salted_join_keeps_every_row(spark):
    """Hot on the left, hot on the right, cold, unmatched and null keys."""
    rows = [(0, i) for i in range(4000)] + [(i % 50 + 1, 4000 + i) for i in range(6000)] + [(60, -2), (None, -1)]
    left = spark.createDataFrame(rows, "k int, v int")
    pairs = [(k, c) for k in range(40) for c in range(2)] + [(60, c) for c in range(3000)] + [(None, 0)]
    right = spark.createDataFrame(pairs, "k int, w int")
    plain = sorted(map(tuple, left.join(right, ["k"]).collect()))
    salted = salted_join(left, right, ["k"], ["v"], ["w"], plain_bytes=0, hot_rows=100)
    assert sorted(map(tuple, salted.collect())) == plain
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    unique = right.select("k").distinct()
    salted = salted_join(left, unique, ["k"], ["v"], plain_bytes=0, hot_rows=100)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, left.join(unique, ["k"]).collect()))


def test_quality(spark):
    topics = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "topic_id bigint, name string")
    cites = spark.createDataFrame([(1, 1), (2, 9), (3, 9)], "citation_id bigint, topic_id bigint")
    assert [tuple(r) for r in check_unique_name(topics).collect()] == [("a", 2)]
    assert [tuple(r) for r in check_citation_fk(cites, topics).collect()] == [(9, 2)]
    raw = spark.createDataFrame([("1", "x"), (None, "2"), ("3", "4")], "a string, b string")
    assert {r["column_name"]: r["n_bad"] for r in check_types(raw, {"a": "bigint", "b": "int"}).collect()} == {"a": 1, "b": 1}


# --- models -----------------------------------------------------------------


def test_retries():
    calls = []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise ValueError("busy")
        return np.array([[1.0]] * len(texts))

    assert run_with_retries(flaky, ["x"], 3) == ([np.array([1.0])], [3], [None])

    def picky(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return np.array([[1.0]] * len(texts))

    rows, tries, errors = run_with_retries(picky, ["a", "bad", "b"], 3)
    assert [r is None for r in rows] == [False, True, False]
    assert (tries, errors) == ([2, 3, 2], [None, "bad text", None])


def test_encoder():
    vectors = HashingEncoder().encode(["a b", "b a", "", "a  b"])
    assert np.allclose(vectors[0], vectors[1]) and np.allclose(vectors[0], vectors[3])
    assert np.isclose(np.linalg.norm(vectors[0]), 1) and not vectors[2].any()
    small = HashingEncoder()
    small.slice_chars = 1
    texts = ["one two three", "", "four", "five six"]
    assert np.array_equal(small.encode(texts), HashingEncoder().encode(texts))


def test_encoder_memory_is_that_of_a_slice():
    """A large batch of words that are all different takes a few megabytes; the sums are the same."""
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(2000)]
    models._token_slot.cache_clear()
    tracemalloc.start()
    got = HashingEncoder(64).encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    whole = HashingEncoder(64)
    whole.slice_chars = 1 << 40
    assert (got == whole.encode(texts)).all()


def test_embed_drops_and_reports(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "  \n"), (3, "more words")], "id int, text string")
    assert {r["id"] for r in topic_embed(df, "text").collect()} == {1, 3}
    kept = topic_embed(df, "text", keep_failures=True)
    assert {r["id"]: r["status"] for r in kept.collect()} == {1: "ok", 2: "rejected", 3: "ok"}
    raw = df.select(embed_column(F.col("text")).alias("e")).select("e.*").collect()
    assert all(r["attempts"] == 1 and r["error"] is None for r in raw)


def test_each_text_pair_is_scored_once(spark):
    class Counting:
        def logits(self, prompts):
            assert len(set(prompts)) == len(prompts)
            return np.array([[0.0, float(len(p))] for p in prompts])

    cites = spark.createDataFrame(
        [(c, i, f"u{i}", s) for c in (1, 2) for i, s in ((1, "same: text"), (2, "same  text"), (3, "other"))],
        "claim_id bigint, citation_id bigint, uri string, sentence string",
    )
    lines = split_claims(spark.createDataFrame([(1, "claim"), (2, "claim")], "claim_id bigint, text string"))
    pairs = stage(claim_premise_pairs(lines, cites), "pairs")
    scored = score_pairs(pairs.coalesce(1), Counting).collect()
    assert len(scored) == 6
    assert len({(r["premise"], r["contra"]) for r in scored}) == 2
    assert all(abs(r["contra"] + r["entail"] - 1) < 1e-12 for r in scored)


def test_failed_score_stops_the_job(spark):
    class Broken:
        def logits(self, prompts):
            raise ValueError("no model")

    pairs = spark.createDataFrame([("p", "h")], "premise string, hypothesis string")
    with pytest.raises(PythonException, match="no score after 3 tries"):
        support_score(pairs, Broken).collect()


def test_failed_scores_can_be_kept(spark):
    class Picky(OverlapScorer):
        def logits(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("a bad pair")
            return super().logits(prompts)

    pairs = spark.createDataFrame([("a b", "a"), ("bad", "a"), ("c", "a")], "premise string, hypothesis string").coalesce(1)
    got = {r.premise: r for r in support_score(pairs, Picky, keep_failures=True).collect()}
    assert len(got) == 3 and got["a b"].error is None and got["a b"].entail > got["c"].entail
    assert (got["bad"].contra, got["bad"].entail) == (None, None) and "a bad pair" in got["bad"].error


def test_support_lists_are_whole(spark):
    rows = [(1, 0, i, "s", "u", 0.5, 0.5) for i in range(500)] + [(2, 0, 1, "s", "u", 0.1, 0.9)]
    scored = spark.createDataFrame(rows, "claim_id bigint, line_no int, citation_id bigint, sentence string, uri string, contra double, entail double")
    nested = support_nested(scored, chunk_rows=50).collect()
    assert sorted(i["citation_id"] for r in nested if r["claim_id"] == 1 for i in r["support"]) == list(range(500))
    assert len([r for r in nested if r["claim_id"] == 1]) == 10
    assert [len(r["support"]) for r in nested if r["claim_id"] == 2] == [1]
