"""The streaming transducer against the library, and its parts against slow ones."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citeloom.llm import bpe_stream
from citeloom.llm.bpe_stream import IdsToText, TextStream, Words, WordStream, WordVocabulary, encode_stream

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "e", "th", "in", "É", "é", "é", "́", "'", "'s", "'re", "'RE", " ", "  ", "\n", "\t", " ", "\x1c", "1", "9", "!", "..."]
PIECES += ["Hello", "WORLD", "Ünï", "ªº²¼", "Ⱥ", "ǅ", "\xad", "\x85", "½x", "ŉ", "#*$%&|<>", "ĸŸ", "--"]
PIECES += ["<|endoftext|>", "<|startoftext|>", "<|end", "<|ENDOFTEXT|>", "ß", "İ", "Σ", "中", "한", "ᄒ", "ᅡ", "ᆫ", "🎉", "x" * 300, "!" * 300, "lo" * 400, "\x00", "ﬁ"]


@pytest.fixture(scope="module")
def vocabulary():
    return WordVocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)]


def test_same_ids_and_text_as_library(vocabulary, library):
    rng = random.Random(2)
    for text in texts(1, 300):
        expected = library.encode(text, add_special_tokens=False).ids
        words = Words(vocabulary.tables)
        words.learn([bpe_stream.split_words(text[: rng.choice([0, 10, 1000])])])
        got = b"".join(encode_stream(text, words, rng.choice([5, 17, 64, 1 << 16])))
        assert np.frombuffer(got, "<u4").tolist() == expected
        stream, ids, at = TextStream(vocabulary.tables), [], 0
        while at < len(text):
            step = rng.choice([1, 2, 3, 50, 400])
            ids += stream.feed(text[at : at + step])
            at += step
        assert ids + stream.finish() == expected
        machine, cut = IdsToText(vocabulary.tables), rng.randint(0, len(expected))
        assert machine.feed(expected[:cut]) + machine.feed(expected[cut:]) + machine.finish() == library.decode(expected, skip_special_tokens=False)


def test_full_table_of_words_stays_right(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "CACHED_WORDS", 12)
    words, slow = Words(vocabulary.tables), []
    monkeypatch.setattr(Words, "__missing__", lambda self, w: slow.append(w) or library_ids(w))

    def library_ids(word):
        return np.array(library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    for batch in (["a b c d e f", "c g h i"], ["a b x y z u v", "c"], ["a b x", "q r s t"], ["a b"]):
        got = [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in bpe_stream.encode_batch(batch, words)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in batch]
    # All of them are plain: none went one by one, before or after the table was full.
    assert not slow and len(words) <= 12


def test_long_run_needs_one_window(vocabulary, library):
    run = "".join(random.Random(4).choices("abcdefghilmnorstu", k=30_000))
    stream, ids = TextStream(vocabulary.tables), []
    for at in range(0, len(run), 1000):
        ids += stream.feed(run[at : at + 1000])
        assert stream.word is None or len(stream.word.open) <= vocabulary.tables.window
        assert len(stream.raw) + len(stream.normal) <= 1000
    assert ids + stream.finish() == library.encode(run, add_special_tokens=False).ids


def slow_merge(symbols, rules):
    parts = list(symbols)
    for left, right in rules:
        out = []
        for part in parts:
            if out and out[-1] == left and part == right:
                out[-1] = left + right
                # What was made is not merged again by the same rule.
                out.append(None)
            else:
                out.append(part)
        parts = [p for p in out if p is not None]
    return parts


def random_rules(rng, n):
    made, rules = ["a", "b", "c"], []
    while len(rules) < n:
        pair = rng.choice(made), rng.choice(made)
        if pair[0] + pair[1] not in made and len(pair[0] + pair[1]) < 7:
            rules.append(pair)
            made.append(pair[0] + pair[1])
    return rules


def test_lookahead_suffices():
    """Whatever follows a prefix, no boundary that lies the lookahead before its end moves."""
    rng = random.Random(7)
    for _ in range(150):
        rules = random_rules(rng, rng.randint(1, 9))
        reach = bpe_stream.sufficient_lookahead(rules)
        for _ in range(30):
            prefix = "".join(rng.choices("abc", k=rng.randint(1, 25)))
            whole = prefix + "".join(rng.choices("abc", k=12))
            settled = [set(np.cumsum([len(t) for t in slow_merge(s, rules)])) for s in (prefix, whole)]
            for at in range(1, len(prefix) - reach + 1):
                assert (at in settled[0]) == (at in settled[1])


def test_lookahead_by_hand():
    assert bpe_stream.sufficient_lookahead([("a", "b")]) == 1
    assert bpe_stream.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert bpe_stream.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    with pytest.raises(ValueError, match="before it makes"):
        bpe_stream.sufficient_lookahead([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError, match="twice"):
        bpe_stream.sufficient_lookahead([("a", "b"), ("ab", "b"), ("b", "b"), ("a", "bb")])


def test_merges_agree_with_slow_ones(vocabulary):
    tables, rng = vocabulary.tables, random.Random(9)
    rules = sorted(tables.rank, key=tables.rank.get)
    words = ["".join(rng.choices("aehlnorst", k=rng.randint(1, 14))) for _ in range(20)] + ["aaaaaaa", "ooooo"]
    ids, sizes = tables.merge_many(words)
    slow = [slow_merge([*w[:-1], w[-1] + tables.suffix], rules) for w in words]
    assert [t for w in slow for t in w] == [tables.names[i] for i in ids]
    assert sizes.tolist() == [len(w) for w in slow]
    assert [tables.merge([*w[:-1], w[-1] + tables.suffix]) for w in words] == slow
    stream = WordStream(tables)
    assert [tables.names[i] for i in stream.feed(words[0]) + stream.finish()] == slow[0]


def test_plain_text_of_ids(vocabulary, library):
    machine = IdsToText(vocabulary.tables, plain=True)
    ids = library.encode("Ünï 中文, 🎉 it's", add_special_tokens=False).ids
    text = "".join(machine.feed([i]) for i in ids) + machine.finish()
    assert text == "ünï 中文 , 🎉 it 's "
    half = vocabulary.tables.ids[bpe_stream.byte_symbols()[0xF0]]
    assert machine.feed([half, half]) + machine.finish() == "��"


def test_digests_of_a_table(spark, vocabulary, library):
    rows = [(i, t, "x") for i, t in enumerate([None, "", " \n", "One two.", "One two.", "z" * 200_000, "word " * 30_000, *texts(5, 40)])] + [(None, "hi", "y"), (3, "One two.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")

    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    found = [tuple(r) for r in bpe_stream.encoding_digests(df, vocabulary).collect()]
    assert sorted(found, key=repr) == sorted((expected(i, t) for i, t, _ in rows), key=repr)
    assert bpe_stream.encoding_digests(df.limit(0), vocabulary).count() == 0
    coded = bpe_stream.decode_ids(bpe_stream.encode_texts(df, vocabulary), vocabulary).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids) for r in coded), key=repr) == sorted(((i, x, library.encode(t or "", add_special_tokens=False).ids) for i, t, x in rows), key=repr)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in coded)
    with pytest.raises(ValueError, match="n_tokens"):
        bpe_stream.encode_texts(df, vocabulary, ids="n_tokens")
