"""The jobs end to end on a small dump."""

import bz2
import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import In

from citeloom.checks.inputs import document_markup, page_xml, write_dump_files
from citeloom.operators import similarity
from citeloom.operators.models import HashingEncoder, OverlapScorer
from citeloom.operators.support import prune_to_topics
from citeloom.plans.classify import classify_claims
from citeloom.plans.ingest import ingest_dump, pages_to_read
from citeloom.plans.pack import files_by_number, load_ranges, pack_files
from citeloom import session
from citeloom.session import scratch, scratch_path, stage
from citeloom.sources.blocks import BlockReader, read_blocks, write_block_index
from citeloom.sources.citation_files import citation_xml_read, citation_xml_write, file_manifest, list_files
from citeloom.sources.dump import (
    articles_per_block,
    block_table,
    dump_lengths,
    dump_read,
    dump_read_blocks,
    index_parse,
    index_rejects,
    locate,
    read_index,
)
from citeloom.sources.outcomes import outcomes_load, run_report
from citeloom.sources.packed import packed_lookup
from citeloom.sources.register import claims, reserve
from citeloom.sources.scores import scores_load
from citeloom.sources.stores import append_topics, citations_load, citations_write, topics_load, topics_write
from citeloom.sources.upkeep import merge_runs, run_sizes, vacuum
from citeloom.streaming.jobs import stream_claims, stream_classify, stream_ingest

WORDS = "river stone cloud maple engine harbor winter copper lantern meadow".split()


def article(i: int) -> str:
    if i % 10 == 9:
        return "#REDIRECT [[Other]]"
    if i % 10 == 8:
        return f"Nothing cited here by {WORDS[i % 10]}."
    url = f"https://ex.org/{i}"
    return (
        f"The {WORDS[i % 10]} & {WORDS[(i // 10) % 10]} <b>met</b>. Then it rained.<ref>{{{{cite web|url={url}|title=T}}}}</ref> Later on.\n\n"
        f"* listed {{{{sfn|A|loc=https://list.org/{i}}}}}\n\n"
        f"{WORDS[(i * 7) % 10]} was {{{{sfn|B|loc={url}/b}}}} here. End."
    )


TITLES = {3: "Help:Three", 4: "List of four", 15: "Article 5"}


def articles(spark, numbers):
    rows = [(i, TITLES.get(i, f"Article {i}"), article(i)) for i in numbers]
    return spark.createDataFrame(rows, "article_id bigint, title string, markup string")


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    """One multi-member file of 60 pages, 7 per block, with its index."""
    folder = tmp_path_factory.mktemp("dump")
    df = articles(spark, range(60))
    pages = [r["xml"] for r in df.select(page_xml(df).alias("xml")).collect()]
    titles = [r["title"] for r in df.collect()]
    data, lines = b"", []
    for first in range(0, 60, 7):
        lines += [f"{len(data)}:{i}:{titles[i]}" for i in range(first, min(first + 7, 60))]
        data += bz2.compress("\n".join(pages[first : first + 7]).encode())
    path = folder / "dump.xml.bz2"
    path.write_bytes(data)
    (folder / "index.txt.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    return str(path), str(folder / "index.txt.bz2")


@pytest.fixture(scope="module")
def index(spark, dump):
    return read_index(spark, dump[1], dump[0])


@pytest.fixture(scope="module")
def lengths(spark, dump):
    return dump_lengths(spark, dump[0])


def expected_names():
    kept = [i for i in range(60) if i % 10 < 8 and i not in (3, 4, 15)]
    return {f"Article {i}" for i in kept}


def stored(spark, store):
    topics, cites = topics_load(spark, store), citations_load(spark, store)
    return {tuple(r) for r in cites.join(topics, "topic_id").select("name", "uri", "sentence", "paragraph").collect()}


def test_blocks_tile_the_file(spark, index, lengths):
    rows = sorted((r["block_start"], r["block_end"], r["n_articles"]) for r in block_table(index, lengths).collect())
    assert rows[0][0] == 0 and rows[-1][1] == lengths.first()["data_len"]
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert sum(r[2] for r in rows) == 60
    assert index_rejects(spark.createDataFrame([("1:2",), ("1:2:",)], "value string")).count() == 1


@pytest.mark.parametrize("per_chunk", [10_000, 2])
def test_block_reader(spark, index, lengths, per_chunk):
    """Every wanted page once, also when a block is read in chunks; misses show."""
    extra = index.where("article_id = 5").withColumn("article_id", F.lit(999).cast("bigint")).withColumn("title", F.lit("Gone"))
    wanted = index.where("article_id > 3").unionByName(extra)
    pages = dump_read_blocks(articles_per_block(wanted, block_table(index, lengths), per_chunk)).collect()
    assert {r["article_id"]: r["markup"] for r in pages} == {**{i: article(i) for i in range(4, 60)}, 999: None}
    assert len(pages) == 57


def test_block_source_opens_only_what_it_needs(spark, dump, tmp_path):
    """Blocks that no filter wants are broken on purpose: reading one would fail."""
    good = open(dump[0], "rb").read()
    path = tmp_path / "copy.xml.bz2"
    path.write_bytes(good)
    index = read_index(spark, dump[1], str(path))
    where = scratch_path(spark, "block-index")
    write_block_index(index, dump_lengths(spark, str(path)), where)
    pages = read_blocks(spark, where)
    assert {r.article_id: (r.title, r.markup) for r in pages.collect()} == {i: (TITLES.get(i, f"Article {i}"), article(i)) for i in range(60)}

    spans = BlockReader(where, 1 << 20).spans()
    assert len(spans) == 9 and spans[0][1] == 0 and spans[-1][2] == len(good)
    broken = bytearray(good)
    for _, start, end in spans[2:]:
        broken[start + 4 : end] = bytes(end - start - 4)
    path.write_bytes(bytes(broken))
    for condition, expected in [
        (F.col("article_id") == 5, {5}),
        (F.col("article_id").isin(1, 8, 13), {1, 8, 13}),
        ((F.col("article_id") < 9) & (F.col("article_id") >= 6), {6, 7, 8}),
        (F.col("title").isin("Article 0", "Article 9"), {0, 9}),
        ((F.col("title") == "Article 5") & (F.col("article_id") < 14), {5}),
        (F.col("title") == "no such title", set()),
        (F.col("article_id").isNull() & (F.col("article_id") < 0), set()),
    ]:
        assert {r.article_id for r in pages.where(condition).collect()} == expected
    # 'Article 5' names page 15 as well, which lies in a broken block.
    with pytest.raises(Exception, match="Invalid data stream|OSError"):
        pages.where("title = 'Article 5'").collect()

    reader = BlockReader(where, 1)
    assert not list(reader.pushFilters([])) and len(reader.partitions()) == 9
    list(reader.pushFilters([In(("article_id",), (1, 13))]))
    assert [p.spans for p in reader.partitions()] == [[spans[0]], [spans[1]]]


def test_scan_reader(spark, dump):
    pages = dump_read(spark, dump[0]).collect()
    assert {r["article_id"]: (r["title"], r["markup"]) for r in pages} == {i: (TITLES.get(i, f"Article {i}"), article(i)) for i in range(60)}


def test_ingest_is_incremental(spark, index, lengths):
    store = scratch_path(spark, "store")
    ingest_dump(index.where("article_id < 20"), lengths, store, "one")
    first = stored(spark, store)
    assert {name for name, *_ in first} == {n for n in expected_names() if int(n.split()[1]) < 20}
    ingest_dump(index, lengths, store, "two")
    topics, cites = topics_load(spark, store), citations_load(spark, store)
    assert {r["name"] for r in topics.collect()} == expected_names()
    assert sorted(r["topic_id"] for r in topics.collect()) == list(range(1, len(expected_names()) + 1))
    assert sorted(r["citation_id"] for r in cites.collect()) == list(range(1, 2 * len(expected_names()) + 1))
    assert first < stored(spark, store)

    # Nothing is left to read; running again changes nothing.
    before = stored(spark, store)
    todo = pages_to_read(index, lengths, store, "three").select(F.explode("articles.title").alias("t")).collect()
    assert not {r["t"] for r in todo} & expected_names()
    ingest_dump(index, lengths, store, "three")
    assert stored(spark, store) == before

    # Repeating a run replaces it, with the same rows.
    ingest_dump(index, lengths, store, "two")
    assert stored(spark, store) == before

    at_five = {(uri, s) for name, uri, s, _ in before if name == "Article 5"}
    assert at_five == {
        # No blank between the stop and the reference: the piece runs on.
        ("https://ex.org/5", "Then it rained.  Later on"),
        ("https://ex.org/5/b", "harbor was   here"),
    }


def test_outcomes_are_kept_and_used(spark, index, lengths):
    class Fussy(HashingEncoder):
        def encode(self, texts):
            if any("maple" in text for text in texts):
                raise ValueError("no maple")
            return super().encode(texts)

    store = scratch_path(spark, "store")
    extra = index.where("article_id = 5").select(index.columns[0], "block_start", F.lit(999).cast("bigint").alias("article_id"), F.lit("Gone").alias("title"))
    bad = index.where("article_id < 2").withColumn("title", F.lit(None).cast("string"))
    whole = index.select(index.columns[0], "block_start", "article_id", "title").unionByName(extra).unionByName(bad.select(extra.columns))
    ingest_dump(whole, lengths, store, "one", Fussy)

    def report(run):
        return {r.reason: r.n for r in run_report(spark, store, run).collect()}

    failed = sum(1 for i in range(60) if i % 10 < 8 and i not in (3, 4, 15) and "maple" in article(i))
    first = report("one")
    # Where page 5 failed, page 15 of the same title is still the repeated one.
    expected = {"redirect": 6, "no cites": 6, "namespace": 2, "title repeated": 1, "missing page": 1, "index line": 2, "embedding failed": failed}
    assert first == {**expected, "stored": len(expected_names()) - failed}
    details = outcomes_load(spark, store).where("reason = 'embedding failed'").select("detail").distinct().collect()
    assert [r.detail for r in details] == ["no maple"]

    again = pages_to_read(whole, lengths, store, "two").select(F.explode("articles.article_id").alias("i")).collect()
    assert len(again) == failed + 1 and 999 in {r.i for r in again}
    ingest_dump(whole, lengths, store, "two")
    present = first["stored"] + (1 if "maple" not in article(5) else 0)
    assert report("two") == {k: v for k, v in {
        "present": present, "seen before": 12, "namespace": 2, "title repeated": 1 - (present - first["stored"]),
        "missing page": 1, "index line": 2, "stored": failed}.items() if v}
    assert {r["name"] for r in topics_load(spark, store).collect()} == expected_names()
    ids = sorted(r["topic_id"] for r in topics_load(spark, store).collect())
    assert ids == list(range(1, len(ids) + 1))


def test_register_gives_ranges_apart(spark):
    store = scratch_path(spark, "store")

    def writer(name):
        return [(f"{name}-{i}", reserve(spark, store, "topic_id", f"{name}-{i}", i + 1, lambda: 7)) for i in range(8)]

    with ThreadPoolExecutor(4) as pool:
        got = dict(pair for pairs in pool.map(writer, "abcd") for pair in pairs)
    taken = sorted((after, after + int(run.split("-")[1]) + 1) for run, after in got.items())
    assert taken[0][0] == 7 and all(a[1] == b[0] for a, b in zip(taken, taken[1:]))
    assert [c.after for c in claims(spark, store, "topic_id")] == [a for a, _ in taken]
    # A repeated run has its ids again, unless it needs more of them.
    assert reserve(spark, store, "topic_id", "b-3", 4) == reserve(spark, store, "topic_id", "b-3", 2) == got["b-3"]
    assert reserve(spark, store, "topic_id", "b-3", 9) == taken[-1][1]
    assert reserve(spark, store, "topic_id", "none", 0) == 0


def test_duplicate_title_keeps_the_lowest_id(spark, index, lengths):
    store = scratch_path(spark, "store")
    ingest_dump(index, lengths, store, "one")
    assert [r["article_id"] for r in topics_load(spark, store).where("name = 'Article 5'").collect()] == [5]


def test_half_written_run_is_not_seen(spark):
    store = scratch_path(spark, "store")
    cites = spark.createDataFrame([(1, 1, 1, "u", "s", "p")], "citation_id bigint, topic_id bigint, file_number bigint, uri string, sentence string, paragraph string")
    citations_write(cites, store, "died")
    assert citations_load(spark, store).count() == 0 and topics_load(spark, store).count() == 0
    topic = spark.createDataFrame([(1, "A", 0, 1, 1, [1.0] + [0.0] * 7)], "topic_id bigint, name string, block_start bigint, block_end bigint, article_id bigint, topic_vector array<float>")
    assert append_topics(spark, store, topic, "ok").count() == 1
    assert citations_load(spark, store).count() == 0
    topics_write(topic, store, "died")
    assert citations_load(spark, store).count() == 1


def test_citation_files(spark):
    texts = ["plain", "a < b & c > d \"q\" 'r'", "  blanks  ", "two\nlines", "ünïcödé", "", "same", "same"]
    texts += ["\x0b tab\t feed\x0c nul\x00 return\r\n end\uffff", "C:\\u000b \\\\ \x1f\\", "back\\slash only"]
    rows = [(i, i // 3, f"https://x.y/?a={i}&b", text) for i, text in enumerate(texts)]
    rows[4] = (4, 1, "urn:a\tb\nc\x01\\d", rows[4][3])
    cites = spark.createDataFrame(rows, "citation_id bigint, file_number bigint, uri string, sentence string")
    path = scratch_path(spark, "files")
    citation_xml_write(cites, path, rows_per_file=2)
    got = citation_xml_read(spark, path).select("citation_id", "file_number", "uri", "sentence").collect()
    assert sorted(map(tuple, got)) == rows

    files = files_by_number(list_files(spark, path))
    assert file_manifest(files).first()["last_file_number"] == 3
    packed, manifest = scratch_path(spark, "packed"), scratch_path(spark, "manifest")
    pack_files(spark, path, packed, manifest)
    total = file_manifest(files).first()["total_bytes"]
    ranges = sorted((r["start_offset"], r["length"]) for r in load_ranges(spark, manifest, total).collect())
    assert ranges[0][0] == 0 and sum(r[1] for r in ranges) == total
    assert all(a[0] + a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert sorted(map(tuple, spark.read.parquet(packed).select("citation_id", "file_number", "uri", "sentence").collect())) == rows


def test_packed_lookup_opens_only_what_it_needs(spark):
    rows = [(i, i // 5, f"urn:{i}", f"text {i} " * 40) for i in range(100)]
    files, packed, manifest, places = (scratch_path(spark, n) for n in ("files", "packed", "manifest", "places"))
    citation_xml_write(spark.createDataFrame(rows, "citation_id bigint, file_number bigint, uri string, sentence string"), files, rows_per_file=3)
    pack_files(spark, files, packed, manifest, places, packed_bytes=400)
    index = spark.read.parquet(places).collect()
    assert sum(r.n_rows for r in index) == 100 and len({r.data_file for r in index}) > 4
    columns = ["citation_id", "file_number", "uri", "sentence"]
    everything = packed_lookup(spark, places, spark.range(30).withColumnRenamed("id", "file_number")).select(columns).collect()
    assert sorted(map(tuple, everything)) == rows
    wanted = {r.data_file for r in index if r.file_number in (3, 11)}
    for r in index:
        if r.data_file not in wanted:
            path = r.data_file.removeprefix("file:")
            open(path, "wb").write(b"broken")
            crc = path.rpartition("/")[0] + "/." + path.rpartition("/")[2] + ".crc"
            if os.path.exists(crc):
                os.remove(crc)
    for numbers in ([3, 11], [3, 11, 999], spark.createDataFrame([(3,), (11,), (3,)], "file_number bigint")):
        got = packed_lookup(spark, places, numbers).select(columns).collect()
        assert sorted(map(tuple, got)) == [r for r in rows if r[1] in (3, 11)]
    assert packed_lookup(spark, places, [999]).count() == 0


@pytest.fixture(scope="module")
def store(spark, index, lengths):
    path = scratch_path(spark, "store")
    ingest_dump(index, lengths, path, "one")
    return path


CLAIMS = [(1, "The river & stone met. Then it rained: https://a.b/c"), (2, "copper was here"), (3, " \n"), (4, "qqq zzz")]


def test_classify(spark, store):
    claims = spark.createDataFrame(CLAIMS, "claim_id bigint, text string")
    rows = classify_claims(claims, topics_load(spark, store), citations_load(spark, store)).collect()
    assert {r["claim_id"] for r in rows} <= {1, 2, 4} and {1, 2} <= {r["claim_id"] for r in rows}
    assert all(abs(r["contra"] + r["entail"] - 1) < 1e-9 and r["sim"] > 0 and 1 <= r["rank"] <= 5 for r in rows)
    per_match = {}
    for r in rows:
        per_match.setdefault((r["claim_id"], r["rank"]), set()).add(r["uri"])
    assert all(len(uris) == 2 for uris in per_match.values())


def test_streams_equal_batches(spark, store):
    topics = topics_load(spark, store)
    source, out = scratch_path(spark, "claims"), scratch_path(spark, "answers")
    claims = spark.createDataFrame(CLAIMS, "claim_id bigint, text string")
    claims.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_claims(stream, topics, out, scratch_path(spark, "position")).awaitTermination()
    from citeloom.plans.classify import match_claims

    columns = ["claim_id", "topic_id", "sim", "rank"]
    batch = match_claims(claims, topics).select(columns).collect()
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, batch))


def test_stream_of_many_claims_equals_a_batch(spark, store, monkeypatch):
    """Batches below the limit of a broadcast go to the topics in parts; the answers are the same."""
    topics, citations = topics_load(spark, store), citations_load(spark, store)
    claims = spark.createDataFrame([(i * 100 + c, text) for i in range(4) for c, text in CLAIMS], "claim_id bigint, text string")
    want = sorted(map(tuple, classify_claims(claims, topics, citations).collect()))
    monkeypatch.setattr(similarity, "PART_CLAIMS", 1)
    source, out, parts = scratch_path(spark, "claims"), scratch_path(spark, "answers"), []
    scan = similarity._scan_all

    def spied(*args):
        found = scan(*args)
        parts.append(found._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
        return found

    monkeypatch.setattr(similarity, "_scan_all", spied)
    claims.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_classify(stream, topics, citations, out, scratch_path(spark, "position")).awaitTermination()
    got = spark.read.parquet(out).select(classify_claims(claims, topics, citations).columns)
    assert want and sorted(map(tuple, got.collect())) == want
    assert len(parts) == 3 and min(parts) > 1


def test_stream_ingest_equals_batch(spark, store):
    folder = scratch_path(spark, "dumps")
    for part in range(3):
        df = articles(spark, range(part * 20, part * 20 + 20))
        df.coalesce(1).select(page_xml(df).alias("value")).write.mode("append").option("compression", "bzip2").text(folder)
    streamed = scratch_path(spark, "store")
    position = scratch_path(spark, "position")
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", 1).text(folder)
        stream_ingest(stream, streamed, position, HashingEncoder).awaitTermination()
    assert {r["name"] for r in topics_load(spark, streamed).collect()} == expected_names()
    assert stored(spark, streamed) == stored(spark, store)
    ids = [r["topic_id"] for r in topics_load(spark, streamed).collect()]
    assert len(set(ids)) == len(ids)


def test_two_streams_into_one_store_keep_both(spark):
    target = scratch_path(spark, "store")
    for part in range(2):
        folder = scratch_path(spark, "dumps")
        df = articles(spark, range(part * 20, part * 20 + 20))
        df.coalesce(1).select(page_xml(df).alias("value")).write.option("compression", "bzip2").text(folder)
        stream = spark.readStream.option("lineSep", "</page>").text(folder)
        before = {tuple(r) for r in topics_load(spark, target).select("topic_id", "name").collect()}
        stream_ingest(stream, target, scratch_path(spark, "position"), HashingEncoder).awaitTermination()
        after = {tuple(r) for r in topics_load(spark, target).select("topic_id", "name").collect()}
        assert before < after
        assert len({i for i, _ in after}) == len(after)


def test_two_streams_at_once(spark, store):
    target, running = scratch_path(spark, "store"), []
    for part in range(2):
        folder = scratch_path(spark, "dumps")
        # Which of two pages of one title comes first is up to the files: leave the later one out.
        df = articles(spark, [i for i in range(part * 30, part * 30 + 30) if i != 15])
        df.repartition(2).select(page_xml(df).alias("value")).write.option("compression", "bzip2").text(folder)
        stream = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", 1).text(folder)
        running.append(stream_ingest(stream, target, scratch_path(spark, "position"), HashingEncoder))
    for one in running:
        one.awaitTermination()
    assert stored(spark, target) == stored(spark, store)
    for table, key in ((topics_load(spark, target), "topic_id"), (citations_load(spark, target), "citation_id")):
        ids = sorted(r[key] for r in table.collect())
        assert ids == list(range(1, len(ids) + 1))
    assert outcomes_load(spark, target).where("reason = 'redirect'").count() == 6


def test_one_bad_score_is_a_row(spark, store):
    class Fails:
        def logits(self, prompts):
            if any("copper" in p for p in prompts):
                raise ValueError("no copper")
            return OverlapScorer().logits(prompts)

    claims = spark.createDataFrame(CLAIMS, "claim_id bigint, text string")
    topics, citations = topics_load(spark, store), citations_load(spark, store)
    rows = classify_claims(claims, topics, citations, make_scorer=Fails, keep_failures=True).collect()
    assert len(rows) == classify_claims(claims, topics, citations).count()
    bad = [r for r in rows if r.error is not None]
    assert 0 < len(bad) < len(rows) and {r.error for r in bad} == {"no copper"}
    assert all((r.contra is None) == (r.error is not None) for r in rows)
    with pytest.raises(Exception, match="no score after 3 tries"):
        classify_claims(claims, topics, citations, make_scorer=Fails).collect()


def test_scores_are_kept_by_content(spark, store):
    class Counting:
        def __init__(self, calls):
            self.calls, self.scorer = calls, OverlapScorer()

        def logits(self, prompts):
            self.calls.add(len(prompts))
            return self.scorer.logits(prompts)

    topics, citations = topics_load(spark, store), citations_load(spark, store)
    scores = scratch_path(spark, "scores")

    def classified(rows, run):
        calls = spark.sparkContext.accumulator(0)
        claims = spark.createDataFrame(rows, "claim_id bigint, text string")
        got = classify_claims(claims, topics, citations, make_scorer=lambda: Counting(calls), store=scores, run=run)
        return sorted(map(tuple, got.collect())), calls.value

    first, called = classified(CLAIMS[:1], "one")
    pairs = {(r[1], r[8]) for r in first}
    assert called == len(pairs) > 0
    again, called = classified(CLAIMS[:1], "two")
    assert again == first and called == 0
    # A repeated run is scored as if it had not been; a known text costs nothing in a new run.
    assert classified(CLAIMS[:1], "one")[0] == first
    more, called = classified([(7, CLAIMS[0][1]), CLAIMS[1]], "three")
    assert [r[1:] for r in more if r[0] == 7] == [r[1:] for r in first] and 0 < called < len(more)
    assert scores_load(spark, scores).count() == scores_load(spark, scores).select("pair").distinct().count()


@pytest.mark.parametrize("pushed_ids", [1000, 0])
def test_pruning_keeps_matched_topics(spark, store, pushed_ids):
    citations = citations_load(spark, store)
    matches = spark.createDataFrame([(1, 3), (2, 5), (2, 3), (2, 999)], "claim_id bigint, topic_id bigint")
    got = prune_to_topics(citations, matches, pushed_ids)
    assert sorted(r.topic_id for r in got.collect()) == [3, 3, 5, 5] and set(got.columns) == set(citations.columns)


def test_stream_state_in_place_of_scans(spark, monkeypatch):
    """Titles of other runs, also those stored while the stream runs, and of earlier batches
    are known; no batch loads the stored tables; a restart goes on."""
    target, folder, position = (scratch_path(spark, name) for name in ("store", "dumps", "position"))

    def drop(numbers):
        df = articles(spark, numbers)
        df.coalesce(1).select(page_xml(df).alias("value")).write.mode("append").option("compression", "bzip2").text(folder)

    def run():
        stream = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", 1).text(folder)
        stream_ingest(stream, target, position, HashingEncoder).awaitTermination()

    def known(name, topic_id):
        return spark.createDataFrame([(topic_id, name, 0, 1, 1, [1.0] + [0.0] * 7)], "topic_id bigint, name string, block_start bigint, block_end bigint, article_id bigint, topic_vector array<float>")

    append_topics(spark, target, known("Article 2", 1), "by hand")
    drop([0, 1, 2, 5])
    run()
    scans = []
    monkeypatch.setattr("citeloom.plans.ingest.topics_load", lambda *a: scans.append(a))
    monkeypatch.setattr("citeloom.plans.ingest.citations_load", lambda *a: scans.append(a))
    topics_write(known("Article 6", 900), target, "meanwhile")
    drop([1, 6, 7, 15, 16])
    run()
    drop([16, 17])
    run()
    assert not scans
    names = sorted(r.name for r in topics_load(spark, target).collect())
    assert names == sorted(f"Article {i}" for i in (0, 1, 2, 5, 6, 7, 16, 17))
    ids = [r.topic_id for r in topics_load(spark, target).where("run like 'stream%'").collect()]
    assert sorted(ids) == list(range(2, 8))
    reasons = sorted((r.article_id, r.reason) for r in outcomes_load(spark, target).collect())
    assert reasons == [(1, "present"), (2, "present"), (6, "present"), (15, "present"), (16, "present")]


def test_merged_runs_are_read_once(spark, store):
    """Fifty small runs become few files; readers see every row once before, during and after;
    a repeated run and a second merge change nothing."""
    target = scratch_path(spark, "store")
    topics, cites = topics_load(spark, store).where("topic_id < 51"), citations_load(spark, store)
    for i in range(50):
        run = f"{i:03d}" if i % 2 else f"run {i}"
        citations_write(cites.where(F.col("topic_id") == i + 1), target, run)
        topics_write(topics.where(F.col("topic_id") == i + 1), target, run)
    citations_write(cites.limit(1), target, "died")
    columns = ["citation_id", "topic_id", "uri", "sentence", "run"]

    def rows():
        return sorted(map(tuple, citations_load(spark, target).select(columns).collect())), sorted(map(tuple, topics_load(spark, target).select("topic_id", "name", "run").collect()))

    def folders():
        return len(topics_load(spark, target).select(F.input_file_name().alias("f")).distinct().collect())

    before, live = rows(), sorted(r.folder for r in run_sizes(spark, target).collect())
    assert len(live) == 50 and len(before[1]) == topics.count()
    reader = topics_load(spark, target)
    assert merge_runs(spark, target, least=8) == 50
    assert rows() == before and folders() == 1
    assert [r.folder.startswith("merged-") for r in run_sizes(spark, target).collect()] == [True]
    assert reader.count() == len(before[1])
    assert merge_runs(spark, target, least=8) == 0
    # One of the merged runs is repeated, as a stream does after a failure; new runs come.
    topics_write(topics.where("topic_id = 2"), target, "001")
    assert rows() == before
    for i in range(8):
        topics_write(topics.where("topic_id = 1").withColumn("topic_id", F.lit(900 + i).cast("bigint")), target, f"new {i}")
    assert merge_runs(spark, target, least=2) == 9
    assert vacuum(spark, target) == 59
    after = rows()
    assert after[0] == before[0] and [r for r in after[1] if r[0] < 900] == before[1] and len(after[1]) == len(before[1]) + 8
    assert folders() == 1


def test_scratch_tables_go_with_their_job(spark, index, lengths):
    with scratch(spark):
        with scratch(spark):
            stage(spark.range(3), "inner")
            path = scratch_path(spark, "kept")
            spark.range(2).write.parquet(path)
        assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    store = scratch_path(spark, "store")
    root = session.checkpoint_root(spark)
    before = set(os.listdir(root.removeprefix("file:")))
    ingest_dump(index.where("article_id < 8"), lengths, store, "one")
    left = set(os.listdir(root.removeprefix("file:"))) - before
    assert left == {store.rpartition("/")[2]}


def test_two_streams_of_claims_keep_both(spark, store):
    topics, out = topics_load(spark, store), scratch_path(spark, "answers")
    for claim_id in (1, 2):
        source = scratch_path(spark, "claims")
        claims = spark.createDataFrame([(claim_id, CLAIMS[0][1])], "claim_id bigint, text string")
        claims.write.parquet(source)
        stream = spark.readStream.schema(claims.schema).parquet(source)
        stream_claims(stream, topics, out, scratch_path(spark, "position"), trigger={"availableNow": True}).awaitTermination()
    assert {r["claim_id"] for r in spark.read.parquet(out).collect()} == {1, 2}


def test_path_spelling_cannot_drop_a_dump(spark, dump):
    spelled = read_index(spark, dump[1], f"file://{dump[0]}")
    assert block_table(spelled, dump_lengths(spark, dump[0])).count() == block_table(read_index(spark, dump[1], dump[0]), dump_lengths(spark, dump[0])).count() > 0
    foreign = spelled.withColumn("dump_path", F.lit("hdfs://elsewhere/dump"))
    with pytest.raises(Exception, match="no length is known"):
        block_table(foreign, dump_lengths(spark, dump[0])).collect()


def test_unknown_schemes_are_named():
    with pytest.raises(ValueError, match="copy the dump"):
        locate("nowhere://x/y")


def test_dump_files_grow_in_number(spark):
    """A stream's files are of bounded size, so no task writes a share of the whole; few
    documents still make one file a batch. No page is lost."""
    documents = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit("Some words. And more.").alias("text"))
    for file_chars, files in ((10**6, 1), (100, 5)):
        path, per_batch = write_dump_files(documents, document_markup(documents), 3, file_chars)
        assert per_batch == files
        assert len(glob.glob(f"{path.removeprefix('file:')}/*.bz2")) == 3 * files
        assert dump_read(spark, path).select("article_id").distinct().count() == 60


def test_packing_lists_the_files_once(spark, tmp_path, monkeypatch):
    """A listing sends a row per file to the driver."""
    from citeloom.plans import pack
    from citeloom.sources import citation_files, packed

    calls = []

    def counted(*given):
        calls.append(given)
        return citation_files.list_files(*given)

    monkeypatch.setattr(pack, "list_files", counted)
    monkeypatch.setattr(packed, "list_files", counted)
    rows = [(i, i // 2, f"https://ex.org/{i}", f"s {i}") for i in range(1, 7)]
    citations = spark.createDataFrame(rows, "citation_id bigint, file_number bigint, uri string, sentence string")
    citation_files.citation_xml_write(citations, f"{tmp_path}/files")
    pack.pack_files(spark, f"{tmp_path}/files", f"{tmp_path}/packed", f"{tmp_path}/index")
    assert len(calls) == 1 and spark.read.parquet(f"{tmp_path}/packed").count() == 6
    assert spark.read.text(f"{tmp_path}/index").count() == 4
