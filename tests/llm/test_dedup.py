"""The prefix join and the suffix dedup against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from citeloom.llm import components, ngram_join, shingles, suffix_dedup

DOCS = "doc_id bigint, text string, cid string, token int, text_ string"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Ä", "é", "日本", "THE", "the"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = [None, "", " \n\t", "one", "One two", "one two", "one two three four", passage, "a" * 400, "x " * 300]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90]))) for _ in range(12)]
    for _ in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), passage)
        texts.append(rng.choice([" ", "\n", " "]).join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def fold(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def brute_sets(rows, width):
    out = []
    for _, text in rows:
        words = [fold(w) for w in WORDS.findall(text or "")]
        n = min(width, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute_components(rows, width, percent):
    sets = brute_sets(rows, width)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_join_against_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    rows += [(500, rows[20][1]), (501, rows[20][1]), (501, rows[20][1]), (None, rows[30][1]), (501, "another text under the same id")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)
    got = ngram_join.join_components(df, width=width, percent=percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows, width, percent)


def test_join_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = ngram_join.join_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)


@pytest.mark.parametrize(("seed", "width", "percent"), [(6, 4, 85), (7, 2, 70)])
def test_join_with_all_tokens_crowded(spark, monkeypatch, seed, width, percent):
    """No pair comes from a token's list: all that the ties leave is found by marks."""
    monkeypatch.setattr(ngram_join, "CROWD", 0)
    monkeypatch.setattr(ngram_join, "BRIDGES", seed % 2)
    rows = corpus(seed)
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, width, percent)


def test_texts_made_from_one_give_no_pairs(spark, monkeypatch):
    """Copies of a text, each changed at places of its own, are not compared by pairs."""
    met = []

    def watched(*given, **options):
        found = pairs_by_differences(*given, **options)
        met.append(found.count())
        return found

    pairs_by_differences = ngram_join.pairs_by_differences
    monkeypatch.setattr(ngram_join, "CROWD", 0)
    monkeypatch.setattr(ngram_join, "BRIDGES", 0)
    monkeypatch.setattr(ngram_join, "pairs_by_differences", watched)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([4, 6, 8])):
            words[at] = f"own{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(200, " ".join(rows[3][1].split()[:-2])), (201, " ".join(rows[3][1].split()[2:]))]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    assert len(met) == 1 and met[0] <= len(rows)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_similar_sets_share_a_mark(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice([4, 12, 40, 300])))
        a = rng.integers(0, 1 << 63, n, np.uint64)
        cut = int(rng.integers(0, n + 1)) if rng.random() < 0.3 else int(n * (100 - percent) / 100 * rng.random())
        grown = int(n * (100 / percent - 1) * rng.random()) + int(rng.integers(0, 2))
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, grown, np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        which, marks, level, room = ngram_join.marks_of([a, np.zeros(0, np.uint64), b], percent)
        assert 1 not in which
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            # The marks that only one has go first: the worst order of all.
            heads = []
            for mine, other in ((0, 2), (2, 0)):
                head = set()
                for kind in set(level[which == mine].tolist()):
                    at = (which == mine) & (level == kind)
                    ranked = sorted(marks[at].tolist(), key=lambda m: (m in marks[which == other], m))
                    head |= set(ranked[: int(room[at][0]) + len(ranked)])
                heads.append(head)
            assert heads[0] & heads[1], (a, b)


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6, 7, 8), (2, "a b c d e", 5, 6, 7, 8)], "doc_id bigint, text string, _first int, _k int, _s int, _own int")
    assert [tuple(r) for r in ngram_join.keep_one_of_each(df).collect()] == [(1, "a b c d e", 5, 6, 7, 8)]


def test_one_of_each_component_stays(spark):
    rows = corpus(5) + [(203, "same text in all of these rows"), (203, "same text in all of these rows"), (204, "same text in all of these rows"), (209, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id for r in kept.collect()))
    want = brute_components(rows, 4, 85)
    assert got == sorted([c for _, c in {(True, c) for _, n, c in want if n}] + [d for d, n, _ in want if not n])


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.keep_one_of_each(empty).columns == empty.columns
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.join_components(blank).select("doc_id", "n_shingles", "component_id").collect())) == [(1, 0, 1), (2, 0, 2)]


def test_shingle_sets_follow_the_words(monkeypatch):
    rows = corpus(6, 60) + [(0, "long " * 50 + "é" * 5000 + " end of it all")]
    whole = shingles.shingle_sets([t for _, t in rows], 4)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    cut = shingles.shingle_sets([t for _, t in rows], 4)
    for a, b, s in zip(whole, cut, brute_sets(rows, 4), strict=True):
        assert np.array_equal(a, b) and len(a) == len(s)


def test_shingles_of_a_batch_take_the_memory_of_a_block():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(1000)]
    shingles.word_hashes(texts[:1])
    tracemalloc.start()
    got = shingles.word_hashes(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [len(h) for h in got] == [400] * 1000
    assert peak - kept < 10_000_000


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(-5, 1050), (7, 7), (3, 2)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys([-5, *range(1000, 1100)], -5)}


def test_more_links_go_through_rounds_alone(spark, monkeypatch):
    """Links that come later give the same components; rounds see those between components
    only, and stars need no second one."""
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    parts = [spark.createDataFrame(p, "a bigint, b bigint") for p in (links[:150], links[150:250], links[250:], links[:150], [(900, 901), (7, 7)])]
    seen = []

    def watched(df, name):
        out = stage(df, name)
        seen.append((name, out.count()))
        return out

    stage = components.stage
    monkeypatch.setattr(components, "stage", watched)
    roots = components.components(parts[0])
    for part in parts[1:3]:
        roots = components.tie(roots, part)
    seen.clear()
    roots = components.tie(roots, parts[3])
    assert all(n == 0 for name, n in seen if name in ("links", "between"))
    roots = components.tie(roots, parts[4])
    everything = spark.createDataFrame([*links, (900, 901)], "a bigint, b bigint")
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, components.components(everything).collect()))
    seen.clear()
    stars = spark.createDataFrame([(1, i) for i in range(2, 90)], "a bigint, b bigint")
    assert {r.root for r in components.components(stars).collect()} == {1}
    assert [name for name, _ in seen] == ["links"]


def brute_cut(rows, length=50):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        order = float("inf") if doc_id is None else doc_id
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            first[key] = min(first.get(key, order), order)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        order = float("inf") if doc_id is None else doc_id
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < order:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone), strict=False))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cut_against_every_position(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed, 60)
    passage = "".join(rng.choice("abcé ") for _ in range(70))
    for i in range(40):
        noise = "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 10, 49, 120])))
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((300 + i, noise + passage[a:b] + noise[::-1] + rng.choice([passage, ""])))
    rows += [(7, rows[50][1]), (7, rows[50][1]), (None, rows[51][1]), (None, rows[51][1]), (900, "ab" * 300), (901, "ba" * 200)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(4)
    got = suffix_dedup.cut_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute_cut(rows)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in got)


def test_cut_of_nothing(spark):
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0
    short = spark.createDataFrame([(1, "x" * 49), (2, "x" * 49), (3, None)], "doc_id bigint, text string")
    assert [r.n_removed for r in suffix_dedup.cut_repeats(short).collect()] == [0, 0, 0]


def test_least_place_is_leftmost():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 7, 31):
        want = [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]
        assert suffix_dedup.least_place(values, width).tolist() == want
