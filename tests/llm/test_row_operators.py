"""Quality, pseudonyms, decontamination, language and main text on small inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, html_text, language, pii, quality

DOCS = "doc_id bigint, text string, lang string, leaks string, kept string, n_words int"
KEY = b"test key"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "x", "y", 1) for d, t, lang in rows], DOCS)


# --- quality ----------------------------------------------------------------


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def quality_texts():
    rng = random.Random(3)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    good = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(60)]
    noisy = [" ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in g.split()) for g in good[:15]]
    loops = [" ".join(w for w in g.split()[:5] for _ in range(9)) for g in good[:10]]
    return good, noisy, loops


def test_counts_and_verdicts(spark):
    good, noisy, loops = quality_texts()
    odd = [None, "", "\n\n", "one", "a b c d e a b c d e", "x\nx\ny\n x\nx", "é\x85\xa0b\x1cc \x0b d", "# | <", "same line\n" * 400]
    rows = [(i, t, None) for i, t in enumerate(good + noisy + loops + odd)] + [(0, good[0], None)] * 2
    judged, model = quality.judge_quality(table(spark, rows))
    got = judged.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        r = by_id[doc_id]
        n, chars, symbols, dup, repeat = slow_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)
    assert all(by_id[i].kept for i in range(60)) and not any(by_id[i].kept for i in range(60, 85))


def test_repeated_words_with_many_distinct_ones():
    ids = np.concatenate([np.arange(9000), np.arange(100, 120), np.arange(9000, 9100)])
    assert quality.repeated_words(ids, 9100) == quality.repeated_words(ids, 1 << 40) == 40


def test_label_model_is_expectation_maximisation():
    patterns = np.array([[1, 1, 1], [-1, -1, 0], [-1, 1, -1], [0, 0, 1]])
    model = quality.fit_label_model(patterns, np.array([80.0, 15.0, 5.0, 10.0]))
    assert model.weights[0][0] < 0 < model.weights[0][2] and model.weights[0][1] == 0


def test_low_quality_rows_go_with_their_columns(spark):
    good, noisy, _ = quality_texts()
    df = table(spark, [(i, t, "en") for i, t in enumerate(good + noisy)])
    kept = quality.drop_low_quality(df)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert quality.drop_low_quality(table(spark, [])).count() == 0


# --- pseudonyms -------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 9, 100, 1000, 1025])
def test_feistel_is_a_permutation(size):
    assert sorted(pii.feistel(v, size, KEY, "t") for v in range(size)) == list(range(size))


def test_formats_are_kept():
    text = (
        "und.34@mail7.example.com 97.51.17.173 9807915762804490 4111 1111 1111 1111 +1 (017) 555-7713 2024-02-29 31.12.1999 "
        'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" 078-05-1120 DE89370400440532013000'
    )
    new, counts = pii.pseudonymise(text, KEY)
    assert counts == {"email": 1, "ipv4": 1, "card": 2, "phone": 1, "date": 2, "secret": 1, "ssn": 1, "iban": 1}
    assert len(new.split()) == len(text.split())
    for a, b in zip(text.split(), new.split(), strict=True):
        if a not in ("+1", "token", "="):
            assert a != b
    card = "".join(new.split()[3:7])
    assert pii.luhn_valid(card) and not pii.luhn_valid(new.split()[2])
    assert all(int(p) < 256 for p in new.split()[1].split("."))
    assert pii.is_date(new.split()[10]) and pii.is_date(new.split()[11])
    iban = new.split()[-1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    again, _ = pii.pseudonymise("see 97.51.17.173!", KEY)
    assert again == f"see {new.split()[1]}!"
    assert pii.pseudonymise(text, b"other")[0] != new


def test_clean_text_stays():
    for text in ["version 3.", "Apache 2.0, CC BY 4.0.", "256.1.1.1 1.2.3.4.5", "1 2 3 4 5 6 7 8 9 10 11 12 13", "a@b", "99.99.1999", "", "no digits"]:
        assert pii.pseudonymise(text, KEY) == (text, {})


def test_ssn_stays_valid():
    for number in ("001-01-0001", "899-99-9999", "665-50-1234", "667-50-1234"):
        assert re.fullmatch(pii.KINDS[6].pattern, pii.ssn_pseudonym(number, KEY))


def test_pseudonyms_of_a_table(spark):
    df = table(spark, [(1, None, "x"), (2, "", "x"), (3, "a.1@mail.org", "x"), (3, "a.1@mail.org", "x"), (4, "b " * 9000 + "a.1@mail.org", "x")])
    new = pii.pseudonymise_texts(df, KEY)
    got = {r.doc_id: r for r in new.collect()}
    assert got[1].text is None and got[2].text == "" and got[3].pii_counts == {"email": 1}
    assert got[4].text.split()[-1] == got[3].text != "a.1@mail.org"
    assert pii.pseudonymise_texts(df, KEY, counts=None).columns == df.columns
    with pytest.raises(ValueError, match="lang"):
        pii.pseudonymise_texts(df, KEY, counts="lang")
    assert pii.pseudonymise_texts(table(spark, []), KEY).count() == 0


# --- decontamination --------------------------------------------------------


def nearest(item, text):
    """Distance of the nearest substring, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def leak_case(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "ation", "er", "ing", "ho", "use", "tree", "x"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))

    items = [(i, prose(rng.choice([2, 8, 25]))) for i in range(12)] + [(50, None), (51, " \n"), (52, "ab"), (53, None)]
    items.append((54, items[1][1]))
    docs = []
    for i in range(40):
        said = rng.choice(items[:12])[1]
        letters = list(said)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            at = rng.randrange(len(letters))
            letters[at] = rng.choice(["", "q", letters[at] + "z"])
        docs.append((i, prose(10) + rng.choice([" ", "\n\n", ". "]) + "".join(letters).upper() + " " + prose(6), "en"))
    return docs + [(90, None, "en"), (91, "", "en"), (92, prose(60), "en"), (0, docs[0][1], "en")], items


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 60), (3, 200)])
def test_leaks_against_all_substrings(spark, seed, block):
    docs, items = leak_case(seed)
    got = decontaminate.find_leaks(table(spark, docs), spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, x int"), block_chars=block).collect()
    want = []
    for doc_id, text, _ in docs:
        said = decontaminate.normalise(text)
        for item_id, item in items:
            item = decontaminate.normalise(item)
            if item and said and (d := nearest(item, said)) <= decontaminate.budget(item):
                want.append((doc_id, item_id, d))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want) and want
    texts, of = {d: decontaminate.normalise(t) for d, t, _ in docs}, dict(items)
    for r in got:
        assert nearest(texts[r.doc_id][r.begin : r.end], decontaminate.normalise(of[r.item_id])) <= r.distance


def test_clean_documents_stay(spark):
    docs, items = leak_case(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = table(spark, docs)
    leaky = {r.doc_id for r in decontaminate.find_leaks(df, bench).collect()}
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - leaky
    with pytest.raises(ValueError, match="leaks"):
        decontaminate.mark_leaks(df, bench)
    assert decontaminate.drop_leaks(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(table(spark, []), bench).count() == 0


# --- language ---------------------------------------------------------------


def speech(language_, rng, n=40):
    syllables = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["ción", "ñ", "que", "dor"]}[language_]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_are_learned(spark):
    rng = random.Random(1)
    rows = [(i, speech(lang, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !?", "cc"), (503, speech("aa", rng, 3000), None), (None, speech("bb", rng), "bb"), (504, "K", "aa")]
    df = table(spark, rows)
    got = language.learn_and_predict(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"] and by_id[500].score == 0
    right = [by_id[d].lang_pred == lang for d, _, lang in rows[:180] if by_id[d].held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    folds = {r.doc_id: r.f for r in df.select("doc_id", language.fold(F.col("doc_id")).alias("f")).collect()}
    assert all(r.held_out == (folds[r.doc_id] == 2) for r in got)


def test_language_without_labels(spark):
    assert [r.lang_pred for r in language.learn_and_predict(table(spark, [(1, "some text", None)])).collect()] == ["und"]
    assert language.learn_and_predict(table(spark, [])).count() == 0


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    net = language.ByteNet.new(["a", "b"], 3)
    windows, wanted = rng.integers(1, 256, (4, 40)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        hidden, _ = net.pooled(windows)
        return -np.log(language.softmax((hidden @ net.dense + net.bias).astype(np.float64))[np.arange(4), wanted]).mean()

    net.embed = net.embed.astype(np.float64)
    net.filters = [f.astype(np.float64) for f in net.filters]
    grads = language.gradients(net, windows, wanted)
    for value, grad in ((net.embed, grads[0]), (net.filters[1], grads[2]), (net.dense, grads[-2])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before = value[at]
        value[at] = before + 1e-4
        up = loss()
        value[at] = before - 1e-4
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-4 - grad[at]) < 0.02 * abs(grad[at]) + 1e-4


# --- main text --------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T &amp; t</h1><p>a <b>b<br>c\n d<p>e&nbsp;f</article><footer>x</footer>", "T & t\na b c d\ne f"),
        ("<nav>m</nav><main><div>one<div class='ad'>buy</div>two</div><form>f</form></main>", "one\ntwo"),
        ("<article>a<section id='comments'><p>bad</p></section><aside>side</aside>b</article>", "a\nb"),
        ("<article>a<script>var x='</p><article>';</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
        ("<article class='comment'>x</article><article>y</article>", "y"),
        ("<p>free &lt;text&gt;</p><div hidden>no</div><div role=navigation>no</div><p>more", "free <text>\nmore"),
        ('<article><a title="a > b">link</a> 1 < 2 &copy; &#233; &unknown;</article>', "link 1 < 2 © é &unknown;"),
        ("<article>a<script>open", "a"),
        ("", ""), (None, ""), ("plain words", "plain words"), ("<<<>>><article", "<<<>>>"),
    ],
)
def test_one_page(page, text):
    main, free, starts, _ = html_text.parse_page(page, 6)
    assert (main if main is not None else html_text.unique_runs(free, starts, [], 6)) == text


def test_repeats_over_a_host_are_boilerplate(spark):
    menu = "<div>Home About us Contact Terms of use Site map</div>"
    tail = "<p>All words here are under the licence of the house</p>"
    stories = [" ".join(f"{w}{i}" for w in "a story that is told once only".split()) for i in range(4)]
    rows = [(i, f"http://a.org/{i}", f"{menu}<p>{stories[i]}</p>{tail}") for i in range(4)]
    rows += [(9, "http://b.org/", menu + "<p>alone on its host</p>"), (10, None, menu), (11, None, menu), (12, "http://a.org/x", f"<article>{menu}</article>{menu}")]
    rows += [(13, "http://c.org/", "<p>one two three four five six seven</p>")] * 2 + [(14, "http://d.org/", None)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [text[i] for i in range(4)] == stories
    said = "Home About us Contact Terms of use Site map"
    assert text[9] == said + "\nalone on its host" and text[10] == said and text[12] == said
    assert text[13] == "one two three four five six seven" and text[14] == ""
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_open_parts_of_an_article_are_compared_over_the_host(spark):
    """Only what other pages of the host have too goes; the rest of the article stays whole."""
    notice = "<p>This site uses small files to count its many readers</p>"
    again = "<p>A paragraph that each of these articles has in its own text</p>"

    def page(i):
        head = f"<div class='post-header'>{notice}<h1>Title {i} of its own</h1></div>"
        return f"<article>{head}{again}<p>see <span class=search-term>word{i}</span> there</p><div class=ad-header>buy</div></article><p>x{i}</p>"

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(3)] + [(3, "http://b.org/", page(3)), (4, None, page(4))] * 2
    rows += [(5, "http://a.org/5", "<div class=page-header><article>sure</article></div>"), (6, "http://c.org/", "<div class=search-box>free</div>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.extract_pages(df).collect())
    body = "A paragraph that each of these articles has in its own text"
    said = "This site uses small files to count its many readers\n"
    want = [(i, f"Title {i} of its own\n{body}\nsee word{i} there") for i in range(3)]
    want += [(i, f"{said}Title {i} of its own\n{body}\nsee word{i} there") for i in (3, 4)] * 2
    assert got == sorted([*want, (5, "sure"), (6, "free")])


def covered_by_hand(pages, shared):
    """By page, the places in its stream that lie under tokens which another page has in a row too."""
    streams = {i: html_text.streamed(list(html_text.page_blocks(page)))[2] for i, page in pages.items()}
    runs = {i: [tuple(s[at : at + shared]) for at in range(len(s) - shared + 1)] for i, s in streams.items()}
    return {i: [at for at, run in enumerate(own) if any(run in runs[j] for j in runs if j != i)] for i, own in runs.items()}


@pytest.mark.parametrize("asked_rows", [0, 1000])
def test_article_text_is_in_the_streams(spark, asked_rows):
    """A free or open block that repeats the article of another page is no text of its own."""
    told = "The harbour was closed for nine days by ice and wind"
    article = f"<nav>Home News Contact</nav><article><p>{told}</p><p>more of it</p></article>"
    askers = {
        1: (f"<p>{told}</p><p>list one</p>", "list one"),
        2: (f"<article><div class=search-term>{told}</div><p>another matter</p></article>", "another matter"),
        3: (f"<article><div class=post-header>{told} after all</div><p>a third</p></article>", f"{told} after all\na third"),
        4: ("<article><p>more words than six that only this one has</p></article>", "more words than six that only this one has"),
    }
    # A host for each, with the article on another page, and one without it.
    rows = [(10 + i, f"http://{i}.org/", article) for i in askers] + [(i, f"http://{i}.org/{i}", page) for i, (page, _) in askers.items()]
    rows += [(5, "http://alone.org/", askers[1][0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_pages(df, asked_rows=asked_rows).collect()}
    want = {i: text for i, (_, text) in askers.items()} | {10 + i: f"{told}\nmore of it" for i in askers}
    assert got == want | {5: f"{told}\nlist one"}
    for i, (page, _) in askers.items():
        free, starts, _ = html_text.streamed(list(html_text.page_blocks(page)))
        covered = covered_by_hand({0: article, i: page}, html_text.SHARED_TOKENS)[i]
        assert got[i] == html_text.unique_runs(free, starts, covered, html_text.SHARED_TOKENS)
