"""Licences, token counts, quality, page text and BPE against brute force and libraries."""

import random
import re
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postpulse.llm import html_text, quality, token_counts
from postpulse.llm.bpe import Decoder, Encoder, encode_and_decode, load, sufficient_lookahead
from postpulse.llm.licenses import COMPLETE, TEMPLATES, THRESHOLD, scan_licenses, template_words
from postpulse.llm.queries import TOKENIZERS
from postpulse.llm.textbytes import chunks, utf8, words

BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"


# ---- licences ---------------------------------------------------------------

def brute_license(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    pieces = [*lowered.split("\n"), *re.split(r"\n[^\w\n]*\n", lowered), lowered]
    units = {tuple(re.findall(r"[^\W_]+", p)) for p in pieces}
    hits = []
    for u in units:
        bag = Bag(zip(u, u[1:], strict=False))
        for number, (licence, template) in enumerate(TEMPLATES):
            w = template_words(template)
            other = Bag(zip(w, w[1:], strict=False))
            if len(u) > 1 and (dice := 2 * (bag & other).total() / (bag.total() + other.total())) >= THRESHOLD:
                hits.append((-dice, number, licence))
    return (min(hits)[2], -min(hits)[0], len(hits)) if hits else (None, None, 0)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "MIT"), (3, "nothing here\n\n\nto see"), (4, "word " * 3000)]
    for i in range(60):
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "License,", "É"])
        notice = " ".join(words).replace(" ", rng.choice([" ", "  ", "\n", " - "])) if i % 3 else " ".join(words).upper()
        rows.append((10 + i, rng.choice(["", "Intro text.\n\n"]) + notice + rng.choice(["", "\nMore.\n", "\n\nMore", " and more"])))
    df = spark.createDataFrame(rows, DOCS).withColumns({"bigram": F.lit(1), "template": F.lit("x"), "dice": F.lit(0)})
    found = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in scan_licenses(df).collect()}
    want = {i: brute_license(t) for i, t in rows}
    assert {k: (a, round(b, 9) if b else b, c) for k, (a, b, c) in found.items()} == {
        k: (a, round(b, 9) if b else b, c) for k, (a, b, c) in want.items()
    }


def test_license_scan_of_repeated_ids_nulls_and_no_rows(spark):
    notice = "Released under the MIT License."
    found = scan_licenses(spark.createDataFrame([(1, notice), (1, notice), (None, notice), (None, "x")], DOCS)).collect()
    assert sorted(((r["doc_id"], r["license"], r["dice"]) for r in found), key=str) == [(1, "MIT", 1.0), (None, "MIT", 1.0)]
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_license_notices_inside_longer_lines_and_complete_texts(spark):
    prose, texts = "some words of the text that stand around it " * 8, dict(COMPLETE)
    owned = lambda name: "Copyright 2020, Some Body. All rights reserved.\n\n" + texts[name].replace("COPYRIGHT HOLDERS", "AUTHORS")
    rows = [
        ("CC-BY-4.0", f"{prose}\nContent licensed under CC BY 4.0 unless noted"), ("MIT", f"{prose}. Released under the MIT License. {prose}"),
        ("MIT", f"{prose}\nReleased under\nthe MIT License. {prose}"), ("GPL-3.0", f"{prose} {TEMPLATES[15][1]} {prose}"),
        ("BSD-3-Clause", owned("BSD-3-Clause")), ("BSD-2-Clause", owned("BSD-2-Clause")), ("BSD-3-Clause", prose + owned("BSD-3-Clause") + prose),
        *((name, text) for name, text in COMPLETE), (None, prose), (None, "the license"), (None, ""), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], DOCS)
    found = {r["doc_id"]: r for r in scan_licenses(df, complete=COMPLETE, inside=True).collect()}
    assert [found[i]["license"] for i in range(len(rows))] == [name for name, _ in rows]
    assert [found[i]["dice"] for i in range(4)] == [1.0] * 4 and found[1]["n_matches"] == 1


# ---- token counts -----------------------------------------------------------

def brute_tokens(word, counter):
    word = token_counts.MARK + word
    scores = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(scores[end - 1][0] + size * counter.rare, scores[end - 1][1] - size)]
        ways += [(scores[b][0] + p, scores[b][1] - 1) for b in range(end) if (p := counter.pieces.get(word[b:end])) is not None]
        scores.append(max(ways))
    return -scores[-1][1]


def test_token_counts_equal_dynamic_programming_word_by_word(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \n ", "日本 語 xé", "a" * 700 + " " + "a" * 690 + "b", "same same same"]
    texts += [" ".join("".join(rng.choice("thenigsé★") for _ in range(rng.randrange(1, 12))) for _ in range(50)) for _ in range(20)]
    counter = token_counts.Counter(token_counts.load(f"{TOKENIZERS}/piece_bpe_32k.model"))
    want = [(len(w := WORD.findall(t or "")), sum(brute_tokens(x, counter) for x in w)) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_tokens int")
    counted, names = token_counts.count_tokens(df, f"{TOKENIZERS}/piece_bpe_32k.model")
    assert names == ["n_words", "n_tokens_2"]
    assert [(r["n_words"], r["n_tokens_2"]) for r in counted.orderBy("doc_id").collect()] == want
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    small = token_counts.Counter(counter.pieces)
    assert [small.count((t or "").encode()) for t in texts] == want
    assert token_counts.count_tokens(df.limit(0), f"{TOKENIZERS}/piece_bpe_32k.model")[0].count() == 0


# ---- quality ----------------------------------------------------------------

def brute_counts(text):
    words, seen, again = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Bag(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def quality_texts():
    rng = random.Random(6)
    texts = ["", None, " ", "\n\n", "a", "\na\na\n", "a\nb\na", "x " * 40, "é # * |", "a b c d e f g h " * 3 + "\na b c d e f g h", "w " * 9000]
    return texts + ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", "\t"]) for _ in range(rng.randrange(80))) for _ in range(300)]


def test_quality_counts_equal_brute_force():
    texts = quality_texts()
    data, offsets = utf8(pa.array(texts, pa.string()))
    for limit in (64, 1 << 21):
        got = []
        for _, _, part, at in chunks(data, offsets, limit):
            found = quality.counts(part, at)
            got += list(zip(*(found[c].tolist() for c in quality.COUNTS), strict=True))
        assert got == [brute_counts(t) for t in texts]


def test_quality_model_on_held_out_rows(spark):
    data_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    inner, outer = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = quality.train(docs, inner)
    again = quality.train(docs.repartition(7), inner)
    assert np.array_equal(model.weights, again.weights)
    judged, names = quality.judge_quality(docs, model)
    rows = judged.join(outer, "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.85
    assert sum(bad) / len(bad) < 0.2


def test_quality_grams_are_of_characters():
    for text in ["", "日", "日本", "日本語", "日本語é", "aé日😀ba", "plain words", "é" * 9]:
        data, offsets = utf8(pa.array(["x日", text, "é"]))
        n = [int(high[1] - low[1]) for _, low, high in quality._grams(data, offsets, words(data, offsets))]
        assert n[2:] == [max(0, len(text) - k + 1) for k in (3, 4, 5)]
        bins, shares = quality.features(text.encode())
        for kind, k in ((2, 3), (3, 4), (4, 5)):
            own = shares[bins // quality._BINS == kind]
            times = Bag(text[i : i + k] for i in range(len(text) - k + 1))
            assert sorted(own) == pytest.approx(sorted(v / times.total() for v in times.values()))
        alone = [b[low[1] : high[1]].tolist() for b, low, high in quality._grams(data, offsets, words(data, offsets))]
        raw, ends = utf8(pa.array([text]))
        assert alone == [b[low[0] : high[0]].tolist() for b, low, high in quality._grams(raw, ends, words(raw, ends))]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_model_keeps_good_rows_that_pass_the_base_rules(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    judged, _ = quality.judge_quality(docs, model)
    rows = judged.join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"), F.count_if("kept").alias("kept")
    ).collect()
    print(sf, rows)
    good, bad = sorted(rows, key=lambda r: -r["quality"])
    assert good["kept"] > 0.9 * good["n"]
    assert good["n"] - good["failed"] - good["kept"] <= 0.01 * good["n"]
    assert bad["kept"] < 0.1 * bad["n"]


def test_quality_without_a_model_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "word " * 3, "b"), (2, " ".join(map(str, range(40))), None)], DOCS + ", kept string")
    judged, names = quality.judge_quality(df, None)
    assert names[-1] == "kept_2"
    assert [(r["doc_id"], r["kept"], r["kept_2"], r["probability"]) for r in judged.collect()] == [
        (1, "a", False, None), (None, "b", False, None), (2, None, True, None),
    ]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.train(df, none) is None
    assert quality.judge_quality(df.limit(0), None)[0].count() == 0


# ---- pages ------------------------------------------------------------------

PAGE = """<html><head><title>no</title></head><body><header><h1>Site</h1></header><nav class="menu"><a>One</a></nav>
<div class="cookie-notice">We use cookies to make it nice for all of you.</div><main><article><h1>The title &amp; more</h1>
<p>First  paragraph with a fair number of words,<br>some <a href=x>linked</a> and some not &lt;b&gt; &#233;.<p><b>Second
<ul><li>One point<li>Two points</ul><div class="ad">Buy this</div></article><section id="comments"><h2>Comments</h2>
<div class="comment">I think this is a long comment about the text above, with many words.</div></section></main>
<aside>Related stuff of many words</aside><form>Name<input></form><footer>&copy; 2020</footer><script>if (a<b) {"</p>"}</script>"""


def test_page_text():
    tree = html_text.grow(*html_text.labelled_rows())
    assert html_text.main_text(PAGE, tree) == (
        "The title & more\n\nFirst paragraph with a fair number of words, some linked and some not <b> é.\n\nSecond\n\nOne point\n\nTwo points"
    )
    rows, labels = html_text.labelled_rows()
    assert sum(html_text.decide(tree, r) == y for r, y in zip(rows, labels, strict=True)) / len(labels) > 0.95


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b", '<p>open <a href="x', "<!-- x", "<script>x", "</p></div>", "<p>" * 3000, "&am", "<" * 2000])
def test_broken_pages_do_not_crash(page):
    html_text.main_text(page, html_text.grow(*html_text.labelled_rows()))


ARTICLE = "A paragraph with a fair number of words that belongs to the main text of this page and is kept."


@pytest.mark.parametrize("begin", [
    "<html><head><title>x</title><body><article><p>", "<head><title>x</title><meta charset=utf-8><article><p>",
    "<HEAD><title>a <b>x</b></title><link rel=x><noscript><img src=x></noscript><script>1</script><BODY class=y><article><p>",
    "<html><head><style>p {}</style></head><body><article><p>", "<head><template><p>no</p></template><main><p>",
    "<head><head><title>x</title><main><p>", "<head><title>x</title><html lang=en><body><main><p>",
])
def test_head_without_its_end_tag(begin):
    found = html_text.blocks(begin + ARTICLE)
    assert [(b.text, b.in_main) for b in found] == [(ARTICLE, True)]
    assert html_text.main_text(begin + ARTICLE, html_text.grow(*html_text.labelled_rows())) == ARTICLE


def test_text_ends_head():
    assert [b.text for b in html_text.blocks(f"<head><title>x</title>\n{ARTICLE}<p>More")] == [ARTICLE, "More"]
    assert [b.text for b in html_text.blocks(f"<head><title>x</title> {ARTICLE}")] == [ARTICLE]
    assert html_text.blocks("<head><title>x <i>y</i></title> <meta name=a>\n</head>") == []


@pytest.mark.parametrize("rest", [
    'style="overflow:hidden"', 'class="content overflow-hidden"', "class=hidden", 'title="hidden gems"', 'href="/hidden-gems"',
    "href=/a/hidden", "data-hidden=true", 'data-x="a hidden b"', 'aria-hidden="false"', 'title="aria-hidden=true"',
    'title="display:none"', 'style="display:none;display:block"', 'style="display:block!important;display:none"',
    'style="backface-visibility:hidden"', 'style="/* display:none */ color:red"', 'style="a:display:none"', 'hidden="false"',
])
def test_only_hiding_attributes_hide(rest):
    assert [b.text for b in html_text.blocks(f"<body><article {rest}><p>One <a {rest}>two</a> three")] == ["One two three"]


@pytest.mark.parametrize("rest", [
    "hidden", "HIDDEN", 'hidden=""', "class='x' hidden", "hidden class=x", "hidden=until-found", 'aria-hidden="true"', "aria-hidden=true",
    'style="display:none"', "style='color:red; Display : NONE !important;'", "style=display:none", 'style="visibility:hidden"',
    'style="display:none" style="display:block"', 'title="a > b" hidden', 'style="display&#58;none"',
])
def test_hiding_attributes_hide(rest):
    assert [b.text for b in html_text.blocks(f"<body><div {rest}>no <b>no</b></div><p>One <i {rest}>two</i> three")] == ["One three"]


def test_visible_inside_invisible():
    page = '<div style="visibility:hidden">no<p style="visibility:visible">yes</p>no</div><div hidden><p style="visibility:visible">no</div>'
    assert [b.text for b in html_text.blocks(page)] == ["yes"]


def test_pages_equal_their_articles(spark, data_dir):
    import html

    pages = spark.read.parquet(f"{data_dir}/pages.parquet").withColumn("text", F.lit("kept"))
    taken, (name,) = html_text.extract_text(pages)
    assert name == "text_2"
    for r in taken.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?h1>|</?p>", article)]
        assert r["text_2"] == "\n\n".join(p for p in parts if p)
    empty, (name,) = html_text.extract_text(spark.createDataFrame([(1, None)], "page_id int, html string"))
    assert empty.collect()[0][name] == ""


# ---- BPE --------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return Encoder(load(BPE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", ".", "!!", "1", "é", "ß", "日", "😀", "'s", "'", "\xa0", "the", "ing", "\r", "\x85", "²", "_", "́", "<|endoftext|>", "<|", "\x1c", "　"]


def test_bpe_equals_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["", " ", "x<|endoftext|>y  <|endoftext|>", "a" * 20000, "=" * 5000, " " * 3000 + "x"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert "".join(Decoder(encoder.tokens).decode(packed, block=3)) == library.decode(want, skip_special_tokens=False)


def test_stream_through_a_small_window_equals_the_whole(encoder):
    rng = random.Random(2)
    small = Encoder(load(BPE), window=encoder.lookahead + 8)
    for pick in (bytes.isalpha, bytes.isdigit, lambda t: t.strip(b"!#$%&()*+-./:;<=>?@[]^_`{|}~") == b""):
        tokens = [t for t in encoder.tokens if t and pick(t)]
        for _ in range(60):
            some = rng.sample(tokens, min(len(tokens), rng.choice([2, 5, 50])))
            raw = b"".join(rng.choice(some) for _ in range(rng.choice([50, 400])))
            blocks = [raw[i : i + 7] for i in range(0, len(raw), 7)]
            assert list(small.stream(blocks)) == small.merge([small.single[b] for b in raw])


def test_lookahead_of_small_merge_lists():
    tokens = [b"a", b"b", b"ab", b"bb", b"abb"]
    assert sufficient_lookahead([], tokens[:2]) == 1
    assert sufficient_lookahead([(0, 1, 2)], tokens[:3]) == 2
    # bb before ab: whether a meets b depends on how far the run of b goes, pair by pair
    assert sufficient_lookahead([(1, 1, 3), (0, 1, 2)], tokens) >= 3


def test_bpe_columns_nulls_and_clashing_names(spark, library):
    df = spark.createDataFrame([(1, None, 5), (None, "Ein Text, zwei.", 6)], DOCS + ", ids int")
    coded, (ids, decoded) = encode_and_decode(df, BPE)
    assert (ids, decoded) == ("ids_2", "decoded")
    rows = coded.orderBy("ids").collect()
    assert (bytes(rows[0][ids]), rows[0][decoded]) == (b"", "")
    assert np.frombuffer(rows[1][ids], "<u4").tolist() == library.encode("Ein Text, zwei.").ids
    assert rows[1][decoded] == "Ein Text, zwei."
    assert encode_and_decode(df.limit(0), BPE)[0].count() == 0
