import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from citeloom.llm import bpe

VOCABULARY = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
DOCS = "doc_id bigint, text string, ids string, key int"


def texts():
    rng = random.Random(5)
    parts = ["a", "bc", " ", "  ", "\n", " \n", "'s", "'re", "'r", "'", "e", "12", "!?", "é", "日本", "\t", " ", "x" * 40, "   \n  ", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(150)] + [
        "a" * 500, " " * 300, "'re" * 200, "\n" * 99 + "x", "1" * 50 + " " * 70 + "z" * 90,
    ]


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (16, 8), (64, 5), (50, 50)])
def test_pieces_encode_as_the_whole(chunk, overlap):
    splitter = VOCABULARY.splitter()
    whole = VOCABULARY.encoding()
    for text in texts():
        chunks = ((o, t, bpe.boundaries(t, splitter)) for _, o, t in bpe.split_chunks(text, chunk, overlap))
        pieces = list(bpe.stitch(chunks, splitter))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def expected(rows):
    coder = VOCABULARY.encoding()
    out = []
    for doc_id, text in rows:
        ids = coder.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_table_against_the_library(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(7, None), (None, "no id"), (3, "long " * 100), (3, "long " * 100), (3, "other " * 100), (None, "z" * 300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    got = bpe.encoding_digests(df, VOCABULARY, chunk=64, overlap=8).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert bpe.encoding_digests(df, VOCABULARY).count() == 0


def test_very_long_run_of_letters():
    assert bpe.encode_piece("ab" * 200_000, VOCABULARY).size > 0


def test_short_texts_take_one_python_process(spark):
    """The vocabulary's tables are built once a task, not by the encoder and the decoder."""
    df = spark.createDataFrame([(1, "one text", "x", 1), (2, "word " * 100, "x", 1)], DOCS)
    plan = bpe.encoding_digests(df, VOCABULARY, chunk=64, overlap=8)._jdf.queryExecution().optimizedPlan().toString()
    short = plan[: plan.index("RepartitionByExpression")]
    assert short.count("MapInArrow") == 2, plan  # short texts, and the digests of the long ones
    encoded = bpe.encode_texts(df, VOCABULARY, chunk=64, overlap=8)
    assert sorted(map(tuple, bpe.digests(encoded[0], VOCABULARY).unionByName(bpe.digests(encoded[1], VOCABULARY)).collect())) == expected(
        [(1, "one text"), (2, "word " * 100)]
    )
