"""The registered queries over whole tables: against SQL where there is SQL, else plain code."""

import hashlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from postpulse.llm import quality
from postpulse.llm.queries import QUERIES, TOKENIZERS
from postpulse.llm.sql import SQL
from test_llm_duplicates import brute_classes, brute_groups, brute_repeats
from test_llm_mix_urls import plain_targets
from test_llm_text import brute_counts


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con(data_dir):
    found = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data_dir}/{name}.parquet')")
    return found


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str) == want


def test_suffix_dedup_query(spark, data_dir, documents):
    got = sorted(tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, data_dir).collect())
    assert got == sorted(
        (d, n, sum(e - b for b, e in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for d, n, spans, kept in brute_repeats(documents, 400)
    )


def test_jaccard_query(spark, data_dir, documents):
    got = sorted((tuple(r) for r in QUERIES["op4_ngram_jaccard"](spark, data_dir).collect()), key=str)
    assert got == brute_classes(documents, 3, 90)


def test_quality_query(spark, data_dir, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, data_dir).collect()}
    for d, t in documents:
        n, chars, symbols, lines, repeated = brute_counts(t)
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality.KEEP)


def test_token_count_and_page_queries_cover_every_row(spark, data_dir, documents):
    assert QUERIES["op5_token_counts"](spark, data_dir).count() == len(documents)
    pages = QUERIES["op9_html_text"](spark, data_dir).collect()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in pages)


def test_bpe_query(spark, data_dir, documents):
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    rows = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, data_dir).collect()}
    for d, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_pipeline_equals_its_stages_done_plainly(spark, con, data_dir):
    docs = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_rules"](spark, data_dir).collect()}
    kept = [r for r in docs if verdicts[r[0]]]
    stays = {g[0] for g in brute_groups([r[:2] for r in kept]) if g[3]}
    kept = [r for r in kept if r[0] in stays]
    classes = {c[0]: c[2] for c in brute_classes([r[:2] for r in kept], 5, 80)}
    kept = [r for r in kept if classes[r[0]] == r[0]]
    assert 0 < len(kept) < len(docs)
    sizes, texts, sources = {}, {}, {}
    for d, t, s in kept:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        texts[d], sources[d] = t, s
    rows = corpus_pipeline.run(spark, data_dir).collect()
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    words, times = dict.fromkeys(sizes, 0), {}
    for r in rows:
        assert r["source"] == sources[r["doc_id"]]
        assert r["decoded"] == texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["decoded"], add_special_tokens=False).ids
        words[r["source"]] += len(r["decoded"].split())
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    longest = max(len(t.split()) for t in texts.values())
    for s, target in plain_targets(sizes).items():
        assert abs(words[s] - target) <= longest + 128


def test_pipeline_stages_with_repeated_and_null_ids(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(7, "same text", "en", "a", 9)] * 3 + [(None, "null text", "en", "a", 9)] * 2 + [(8, "Same text", "en", "a", 9), (9, "x", "en", "b", 1)]
    left = corpus_pipeline.exact_dedup(spark, spark.createDataFrame([*rows, (8, "Same text", "en", "a", 9)], schema), "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == [(8, "Same text"), (9, "x"), (None, "null text")]

    many = [(5, "", "en", "a", 0)] + [(None if i % 2 else 5, f"{'word ' * 40}{i}", "en", "abc"[i % 3], 0) for i in range(100, 400)]
    taken = corpus_pipeline.source_mix(spark, spark.createDataFrame(many, schema), "").groupBy("source").count().collect()
    words = {r["source"]: 41 * r["count"] for r in taken}
    for source, target in plain_targets(dict.fromkeys("abc", 4100)).items():
        assert abs(words[source] - target) <= 41 + 128
