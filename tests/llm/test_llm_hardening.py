"""Inputs made to break hashes, page hints and the sample of labels."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from postpulse.llm import html_text, quality
from postpulse.llm.ngram_join import jaccard_classes
from postpulse.llm.suffix_dedup import remove_repeats
from postpulse.llm.textbytes import piece_hashes, utf8
from test_llm_duplicates import brute_repeats
from test_llm_text import brute_counts

TREE = html_text.grow(*html_text.labelled_rows())


def thue_morse(n, a="a", b="b"):
    one, other = a, b
    while len(one) < n:
        one, other = one + other, other + one
    return one, other


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 8192])
def test_constructed_words_differ(spark, n):
    one, other = thue_morse(n)
    data, at = utf8(pa.array([one, other, one]))
    hashes = piece_hashes(data, at[:-1], at[1:])
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_classes(df, words=3, percent=90).collect()) == [(1, 1), (2, 2), (3, 1)]
    texts = [f"{one}\n{other}\n{one}", " ".join([one] * 8 + [other] * 8), " ".join([one, other] * 9)]
    data, at = utf8(pa.array(texts))
    found = quality.counts(data, at)
    assert list(zip(*(found[c].tolist() for c in quality.COUNTS), strict=True)) == [brute_counts(t) for t in texts]


def test_constructed_passages_are_judged_by_their_bytes(spark):
    one, other = thue_morse(2048)
    rows = [(1, "x" + one), (2, "y" + other), (3, one[:700] + "z" + other[900:1700])]
    got = {r["doc_id"]: (tuple((s["begin"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in
           remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {d: (tuple(tuple(s) for s in spans), bytes(kept)) for d, _, spans, kept in brute_repeats(rows, 400)}
    assert got == want


def test_hashes_of_all_lengths_and_places():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    begins = rng.integers(0, 3800, 3000)
    ends = begins + rng.integers(0, 130, 3000)
    hashes = piece_hashes(data, begins, ends)
    by_piece = {}
    for b, e, h in zip(begins.tolist(), ends.tolist(), hashes.tolist()):
        assert by_piece.setdefault(data[b:e].tobytes(), h) == h
    assert len(set(by_piece.values())) == len(by_piece)


THEMES = [
    "<body class='no-sidebar'>", "<body class='post-template has-sidebar'>", "<body class='header-fixed menu-closed'>",
    "<body id='sidebar'>", "<html class='cookie-consent-given no-js'><body>", "<body class='modal-open'>", "<body class='nav-fixed sidebar-mini'>",
    "<body class='single single-post comments-open'>", "<body class='home blog widget-page'>", "<body role='banner'>",
    "<body><form id='aspnetForm'>", "<body><form class='search'>", "<body><div class='page-with-menu'>", "<body><div id='thread-12'>",
    "<body><div class='sidebar-right layout'>", "<body><div class='header'>", "<body><div id='comments-enabled'>", "<body><div class='social'>",
    "<body><div class='without-nav'>", "<body><fieldset>", "<body><div class='widget'>", "<body><div class='responses'>",
    "<body><div class='ads-disabled'>", "<body><div class='sticky-header is-active'>", "<body><section class='related'>",
    "<body><div class='notification-off'>", "<body><div id='share'>", "<body><div class='newsletter'>", "<body><div class='search-page'>",
    "<body><div class='topbar-hide'>",
]


def test_ordinary_names_leave_given_pages_alone():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    want = [html_text.main_text(p, TREE) for p in pages]
    assert all(want)
    for begin in THEMES:
        got = [html_text.main_text(p.replace("<body>", begin, 1), TREE) for p in pages]
        assert got == want, begin


ARTICLE = "<h1>A headline of the story</h1><p>" + "Plain words of a story that goes on. " * 9 + "</p><p>" + "More of the same story, told again. " * 7 + "</p>"


@pytest.mark.parametrize("begin", ["<article class='post comments-open'>", "<article id='thread-12'>", "<main class='sidebar'>", "<article class='widget'>"])
def test_article_itself_is_never_furniture(begin):
    assert html_text.main_text(f"<body><nav><a>Home</a></nav>{begin}{ARTICLE}", TREE).startswith("A headline")


def test_headline_in_entry_header_stays_and_furniture_goes():
    head = "<div class='entry-header'><h1>A headline of the story</h1></div>"
    rest = ARTICLE[ARTICLE.index("<p>"):]
    page = (f"<body><div class='site-header'>Our site of news</div><div class='main-nav'><a>One</a> <a>Two</a></div><article>{head}{rest}"
            "<div class='share-buttons'>Share this story now</div></article><div id='comments'><p>" + "I do not agree with any of it. " * 60
            + "</p></div><div class='sidebar'><p>Read these other stories as well today</p></div><div class='cookie-banner'>We use cookies here</div>")
    text = html_text.main_text(page, TREE)
    assert text.startswith("A headline of the story\n\nPlain words")
    for word in ("Our site", "Two", "Share", "agree", "Read these", "cookies"):
        assert word not in text


def test_empty_table_of_pages(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id int, html string"))[0].collect() == []


def test_training_takes_one_row_of_an_id(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality, "fit", lambda rows, share: sent.append((len(rows), share)))
    docs = spark.createDataFrame([(i % 4, f"text number {i}") for i in range(400)] + [(4, None), (None, "x")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, 1)], "doc_id int, quality int")
    quality.train(docs, labels, sample=50)
    quality.train(docs, labels, sample=1)
    assert sent == [(4, 0.5), (2, 0.5)]
    none = spark.createDataFrame([(4, 1), (5, 0)], "doc_id int, quality int")
    assert quality.train(docs, none) is None  # labels without a text use up nothing
