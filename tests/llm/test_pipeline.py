"""The pipeline against its stages done one by one in plain Python."""

import random

from citeloom.llm import decontaminate, pii, quality
from test_bpe import expected
from test_dedup import brute_components

import corpus_pipeline


def documents():
    rng = random.Random(11)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    base = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(40)]
    items = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(3)]
    texts = list(base)
    texts += [b.replace(b.split()[5], "changed") for b in base[:8]] + base[:5]
    texts += [" ".join(w + "***" for w in b.split()) for b in base[10:20]]
    texts += [base[20] + "\n" + items[0] + " the end of this one"]
    texts += [" ".join(rng.choice(words) for _ in range(60)) + " mail a.17@mail.org and 97.51.17.173 now."]
    texts += [None, "", "too short"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows, list(enumerate(items))


def test_run_against_plain_python(spark, tmp_path):
    rows, items = documents()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    judged, _ = quality.judge_quality(df)
    good = {r.doc_id for r in judged.collect() if r.kept}
    assert good == {d for d, t in rows if t and "***" not in t and len(t.split()) >= 10}
    kept = [r for r in rows if r[0] in good]
    first = {c for _, _, c in brute_components(kept, 5, 80)}
    kept = [r for r in kept if r[0] in first]
    kept = [r for r in kept if not any(decontaminate.normalise(i) in decontaminate.normalise(r[1]) for _, i in items)]
    hidden = [(d, pii.pseudonymise(t, corpus_pipeline.PII_KEY)[0]) for d, t in kept]
    assert hidden != kept
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == expected(hidden)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(0, "an item of the benchmark")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, "word " * 3, "en", "s", 15), (None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, work in corpus_pipeline.STAGES[:-1]:
            assert work(spark, docs, str(tmp_path)).columns == docs.columns, name
            assert work(spark, docs, str(tmp_path)).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
