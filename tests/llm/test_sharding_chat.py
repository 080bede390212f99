import hashlib
import zlib
from collections import defaultdict

import numpy as np

from citeloom.llm import chat, sharding


def one_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    keys = np.arange(-50, 3000, dtype=np.int64)
    got = sharding.jump_hash(keys.view(np.uint64), 24)
    assert got.tolist() == [one_jump(int(k) % 2**64, 24) for k in keys]
    grown = sharding.jump_hash(keys.view(np.uint64), 25)
    moved = got != grown
    assert set(grown[moved]) == {24} and 0.02 < moved.mean() < 0.07
    assert np.bincount(got).min() > 0.6 * len(keys) / 24


def test_placement(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(5, "text 5")] * 40 + [(None, None), (None, ""), (9, None), (9, "é" * 70_000)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, shard string, slot int")
    got = sharding.placement(df, 7, buckets_per_shard=3).collect()
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == one_jump(r.doc_id or 0, 7) and r.grown_shard == one_jump(r.doc_id or 0, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_PER_ROW", 3)
    df = spark.createDataFrame([(1, "same")] * 10, "doc_id bigint, text string")
    assert sorted(r.slot for r in sharding.placement(df, 4).collect()) == list(range(10))


def test_placement_of_nothing(spark):
    assert sharding.placement(spark.createDataFrame([], "doc_id bigint, text string"), 24).count() == 0


def test_escapes_are_reversible():
    for text in ["", "<|im_end|>", "<\\|x", "<\\\\|", "<<|", "<", "|", "a<|b<\\|c", "\\n", "x\\"]:
        assert chat.unescape_text(chat.escape_text(text)) == text
        assert "<|" not in chat.escape_text(text)
        assert chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"


def test_chat(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>\n"), (1, 2, "assistant", "<\\|ok<|im_start|>"),
        (2, 1, "assistant", "b"), (2, 0, "user", None), (2, 2, "assistant", "again"),
        (3, 0, "user", "only"), (None, 5, None, "x"), (None, 5, None, "x"), (4, 0, "ro\nle", ""),
    ]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        under = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert [got[c].in_order for c in (1, 2, 3, 4)] == [True, False, True, False]
    assert [got[c].complete for c in (1, 2, 3)] == [True, False, False]


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(df)).count() == 0
