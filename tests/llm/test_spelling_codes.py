"""Spelling groups and vector codes against brute force."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from citeloom.llm import gnat_codes, spelling

PATTERN = "[A-Za-zÀ-ÿ]+"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def vocabulary(seed, n=250):
    rng = random.Random(seed)
    words = {"a" * k for k in (5, 6, 7, 9)} | {"abcde", "abcdé", "bcde", "abcdef", "xabcde", "÷×àáâ", "aaaaab", "baaaaa"}
    stems = ["".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(12)]
    while len(words) < n:
        w = list(rng.choice(stems) + rng.choice(stems))
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        words.add("".join(w))
    words.discard("")
    return {w: rng.choice([3, 3, 4, 6, 8, 12, 20, 48]) for w in sorted(words)}


@pytest.mark.parametrize("most", [2, 7, 10_000])
def test_groups(spark, most):
    counts = vocabulary(most)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, most).collect()}
    assert found == brute_groups(counts)
    pairs = [(r.a, r.b) for r in spelling.near_words(df, most).collect()]
    assert len(pairs) == len(set(pairs)) == sum(near(a, b) for a, b in combinations(counts, 2))


def test_partitions_stay_small(spark):
    """A third of the words and more share their first and last letters."""
    rng = random.Random(1)
    words = {"inter" + "".join(rng.choices("ab", k=6)) + "nation" for _ in range(200)}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n bigint")
    placed = spelling.partitions(df, 8)
    sizes = placed.groupBy(*spelling.PLACE).count().collect()
    assert all(r["count"] <= 8 or r.hi - r.lo == 1 for r in sizes)


def test_word_counts(spark):
    texts = [None, "", "Hello hello HELLO, world-wide", "ÀÉ÷×ÿÿ Straße " * 3, "word" * 20_000, "hello wörld9wörld _wörld"]
    rows = [(i if i != 4 else None, t, "x", 7) for i, t in enumerate(texts)] + [(2, texts[2], "y", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int")
    expected = Counter()
    for doc, text, *_ in rows:
        folded = "".join(c.lower() if c.isascii() else c for c in text or "")
        run = ""
        for c in folded + " ":
            if (c.isascii() and c.isalpha()) or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                sign = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                at = sign % len(run)
                expected[run[:at] + run[at + 1 :] if sign % 3 == 0 else run] += 1
            run = ""
    found = {r.word: r.n for r in spelling.word_counts(df, PATTERN, slips=3, min_chars=4, min_count=2).collect()}
    assert found == {w: n for w, n in expected.items() if len(w) >= 4 and n >= 2}
    assert spelling.word_counts(df.limit(0), PATTERN).count() == 0


def test_no_words(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p in range(parts):
                q = v[p * width : (p + 1) * width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        numbers = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [r[1][p * width : (p + 1) * width] for r, n in zip(kept, numbers) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    numbers = assign()
    errors = [sum(d for d, _ in n) for n in numbers]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    return [(i, "".join(f"{e:02x}" for _, e in n), error, by_label[label]) for (i, _, label), n, error in zip(kept, numbers, errors)]


@pytest.mark.parametrize("scale", [1.0, 1e-4, 3e9])
def test_codes(spark, scale):
    """Ties, repeated rows and ids, null ids, labels and components; numbers past a double's
    whole numbers at the largest scale."""
    rng = random.Random(int(scale))
    rows = [(i, [scale * rng.choice([0.0, 0.25, -0.25, rng.random()]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3], (3, rows[9][1], 2), (None, rows[5][1], None), (70, None, 1), (71, [None] * 16, 1), (-1, [float("nan")] * 16, 1), (-2, [float("inf")] * 16, 2)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, _label int")
    if scale > 1:
        books = gnat_codes.learn_codebooks(df, "vec_id", "embedding", rounds=1)
        assert all(isinstance(x, int) for part in books.entries for row in part for x in row)
        return
    found = gnat_codes.compress(df).collect()
    key = repr
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=key) == sorted(brute_codes(rows), key=key)
    assert len({r.codebooks_sha256 for r in found}) == 1


def test_tree_finds_nearest_and_skips():
    rng = np.random.default_rng(5)
    for kind, top in ((np.float64, 6), (np.float64, 1 << 20), (object, 1 << 60)):
        centres = rng.integers(-top, top, (5, 4))
        entries = (centres[rng.integers(0, 5, 40)] + rng.integers(-2, 3, (40, 4))).astype(kind)
        queries = np.concatenate([entries, (centres[rng.integers(0, 5, 200)] + rng.integers(-3, 4, (200, 4))).astype(kind)])
        best, far, measured = gnat_codes.nearest_entries(gnat_codes.build(entries), entries, queries)
        exact = [min((sum(int(a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(entries)) for q in queries]
        assert [(int(d), int(k)) for d, k in zip(far, best)] == exact
        if top > 6:
            assert measured < 0.7 * len(queries) * len(entries)


def test_codes_of_few_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert gnat_codes.compress(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 8, None)], schema)
    row = gnat_codes.compress(one).first()
    assert (row.code, row.error, row.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(Exception, match="multiple of 8"):
        gnat_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], schema)).collect()
