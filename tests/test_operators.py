"""Operators on small frames: dedupe directions, labels, searches, aggregates, retrieval, sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from postpulse.functions.models import CountingScorer, TaggingTranslator
from postpulse.operators import (
    aggregates as A, cleaning as C, enrich as E, latest as L, relevance as R, retrieval as G,
    saved_search as S,
)
from postpulse.operators.joins import keep_first, keep_last, spread_join
from postpulse.plans import jobs
from postpulse.sources import lake, payloads, schema, tables
from postpulse.streaming import live


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- keys, joins, defaults ----

def test_keep_first_and_last_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, o int")
    for parts in (1, 3):
        d = df.repartition(parts)
        assert rows(keep_first(d, ["k"], ["o"]), "k", "o") == [("a", 1), (None, 3)]
        assert rows(keep_last(d, ["k"], ["o"]), "k", "o") == [("a", 2), (None, 4)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("o"))
    plan = keep_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_spread_join_equals_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["k"], how)
        assert rows(spread_join(left, right, ["k"], how), *want.columns) == rows(want, *want.columns)


def test_timestamps_are_parsed_one_by_one(spark):
    df = spark.createDataFrame(
        [("2026-04-28T14:02:00Z",), ("2026-04-28",), ("04/28/2026",), ("Wed Aug 27 13:08:45 +0000 2008",),
         ("garbage",), (None,)], "created_at string")
    got = [str(r[0]) for r in C.with_created_at(df, "2030-01-01 00:00:00").collect()]
    assert got == ["2026-04-28 14:02:00", "2026-04-28 00:00:00", "2026-04-28 00:00:00",
                   "2008-08-27 13:08:45", "2030-01-01 00:00:00", "2030-01-01 00:00:00"]


def test_defaults_and_stable_ids(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    one = rows(C.with_defaults(df, "2024-01-01 00:00:00"), "tweet_id", "author", "source")
    two = rows(C.with_defaults(df.repartition(2), "2024-01-01 00:00:00"), "tweet_id", "author", "source")
    assert one == two and {r[1:] for r in one} == {("unknown", "manual_or_sample")}
    assert len({r[0] for r in one}) == 2


def test_repair_ids(spark):
    df = spark.createDataFrame([("t", "i", "d"), (None, "i", "d"), (None, None, "d")],
                               "tweet_id string, id string, doc_id string")
    assert [r[0] for r in C.repair_ids(df).select("tweet_id").collect()] == ["t", "i", "d"]
    bare = C.repair_ids(spark.createDataFrame([("x",)], "text string"), F.lit("run9"))
    assert bare.first()["tweet_id"].startswith("run9_")


def test_union_directions(spark):
    a = spark.createDataFrame([("1", "old", 1), ("2", "old", 2)], "doc_id string, text string, o int")
    b = spark.createDataFrame([("2", "new", 1), ("3", "new", 2), ("3", "newer", 3)], a.schema)
    assert rows(C.append_to_base(a, b, "o"), "doc_id", "text") == [("1", "old"), ("2", "old"), ("3", "new")]
    assert rows(C.combine_corpora(a, b, "o"), "doc_id", "text") == [("1", "old"), ("2", "new"), ("3", "newer")]


def test_filters(spark):
    df = spark.createDataFrame(
        [("Rates up", "BBVA", "monetary_policy", None, None), ("hello", "TSLA", None, "es", False),
         ("x", None, None, "en", True)],
        "text string, primary_ticker string, topic string, lang string, is_noise boolean")
    assert C.by_keywords(df, "BBVA  rates policy").count() == 1
    assert C.by_keywords(df, "   ").count() == 3
    assert C.by_language(df).count() == 2
    assert C.without_noise(df).count() == 1
    assert C.by_ticker(df, "all").count() == 3 and C.by_ticker(df, "TSLA").count() == 1


# ---- pipeline and models ----

def test_process_posts(spark):
    df = spark.createDataFrame(
        [("x1", "$AAPL raised, growth ahead", 1), ("x2", "$TSLA cut, risk ahead", 2), ("x1", "later", 3),
         ("x3", "@only", 4), ("x4", "", 5), ("x4", "kept", 6)], "tweet_id string, text string, o int")
    got = E.process_posts(df, order="o")
    assert rows(got, "tweet_id", "clean_text", "sentiment", "primary_ticker") == [
        ("x1", "$AAPL raised, growth ahead", "positive", "AAPL"),
        ("x2", "$TSLA cut, risk ahead", "negative", "TSLA"), ("x4", "kept", "neutral", "UNMAPPED")]
    again = E.process_posts(df.repartition(4).orderBy(F.rand(3)), order="o")
    assert rows(again, "tweet_id", "clean_text") == rows(got, "tweet_id", "clean_text")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_model_sentiment(spark):
    class TwoLabels(CountingScorer):
        labels = ("Negative", "Positive")

        def load(self):
            return lambda texts: np.array([[0.5, 0.5] if t == "tie" else [0.1, 0.9] for t in texts])

    df = spark.createDataFrame([("tie",), ("up",), (None,)], "clean_text string")
    got = E.with_model_sentiment(df, TwoLabels(), batch_size=2)
    assert rows(got, "sentiment", "sentiment_confidence", "positive_prob", "neutral_prob", "sentiment_score") == [
        ("negative", 0.5, 0.5, 0.0, 0.0), ("positive", 0.9, 0.9, 0.0, 0.8), ("positive", 0.9, 0.9, 0.0, 0.8)]
    with pytest.raises(ValueError):
        E.with_sentiment(df, "finbert")


def test_rewrites_stay_with_their_row(spark):
    df = spark.createDataFrame(
        [("1", "peso sube", 1), ("1", "duplicate", 2), ("2", "plain stock", 3), ("3", "tasa Baa3", 4),
         ("4", "deuda alza", 5)], "tweet_id string, text string, o int")
    got = E.process_with_rewrites(df, TaggingTranslator(fail_on="Baa3"), order="o", cap=2)
    assert rows(got, "tweet_id", "text", "clean_text", "translation_model", "translation_reason") == [
        ("1", "peso sube", "[en] peso sube", "tagging-translator", "non_english_financial_text"),
        ("2", "plain stock", "plain stock", "none", "not_translated"),
        ("3", "tasa Baa3", "tasa Baa3", "failed", "ValueError"),
        ("4", "deuda alza", "deuda alza", "none", "not_translated")]
    off = E.with_rewrites(df, TaggingTranslator(), order="o", disabled=True)
    assert {r[0] for r in off.select("translation_reason").collect()} == {"disabled"}


# ---- relevance ----

def test_heuristic_labels(spark):
    df = spark.createDataFrame(
        [("1", "NVDA earnings: more AI chip demand, shares up", False, "unknown"),
         ("2", "free crypto airdrop, an NVDA giveaway", False, "unknown"),
         ("3", "stock up", True, "institution"),
         ("4", "the football stock market is a meme", True, "institution"),
         ("5", "celebrity movie about chips and cloud risk", False, "unknown")],
        "tweet_id string, text string, is_curated_market_author boolean, author_reliability_tier string")
    got = {r["tweet_id"]: r for r in R.with_heuristic_labels(df, "NVDA").collect()}
    assert (got["1"]["is_noise"], got["1"]["relevance_score"]) == (False, 0.85)
    assert got["2"]["is_noise"] and got["3"]["is_noise"]
    assert got["4"]["noise_reason"] == "heuristic_curated_author_institution_market_context"
    assert got["5"]["relevance_score"] == 0.10
    dollar = R.with_heuristic_labels(df, "$").filter("tweet_id = '5'").first()
    assert dollar["is_noise"]  # social noise without strong context, although '$' matches everything


def test_attach_labels(spark):
    df = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "tweet_id string")
    labels = spark.createDataFrame([("1", 1, True, 0.1, "a"), ("1", 2, False, 0.9, "b")],
                                   "tweet_id string, o int, is_noise boolean, relevance_score double, noise_reason string")
    assert rows(R.attach_labels(df, labels, "o"), "tweet_id", *R.LABEL_COLUMNS) == [
        ("1", False, 0.9, "b"), ("2", True, 0.0, "unlabeled"), ("2", True, 0.0, "unlabeled"),
        (None, True, 0.0, "unlabeled")]


def test_labels_by_call(spark):
    post = "NVDA stock earnings beat guidance this quarter"
    df = spark.createDataFrame([(q, t, post) for q in (1, 2, 3) for t in ("a", "b")], "question_id int, tweet_id string, text string")
    labels = spark.createDataFrame(
        [(1, "a", 2, True, 0.1, "later"), (1, "a", 1, False, 0.9, "earlier"), (2, "a", 1, False, 0.7, "two"), (2, "b", 1, False, 0.6, "two"),
         (3, "a", 1, None, None, None)],
        "question_id int, tweet_id string, o int, is_noise boolean, relevance_score double, noise_reason string")
    got = R.label_posts(df, "NVDA", labels, "o", "question_id")
    guess = (False, 0.85, "heuristic_financial_or_macro_relevance")
    assert rows(got, "question_id", "tweet_id", *R.LABEL_COLUMNS) == [
        (1, "a", True, 0.1, "later"), (1, "b", True, 0.0, "unlabeled"), (2, "a", False, 0.7, "two"), (2, "b", False, 0.6, "two"),
        (3, "a", *guess), (3, "b", *guess)]


def test_parse_labels(spark):
    a, b = '{"tweet_id": "1", "is_noise": false, "relevance_score": 0.5, "reason": "ok"}', '{"tweet_id": 2}'
    cases = [f"[{a}, {b}]", f"```json\n[{a},{b}]\n```", f"Sure: [{a},{b}] bye", f'{{"labels": [{a},{b}]}}',
             f'[{a},{b},{{"tweet_id": "3", "is_no', f"{a}\n{b}", f"note {a}, {b} end"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "n int, response string")
    got = R.parse_labels(df)
    for i in range(len(cases)):
        assert rows(got.filter(F.col("n") == i), "tweet_id", "is_noise", "relevance_score", "noise_reason") == [
            ("1", False, 0.5, "ok"), ("2", True, 0.0, "external")], cases[i]
    single = spark.createDataFrame([(a,), ("nothing",), (None,)], "response string")
    assert R.parse_labels(single).count() == 1


def test_ranking_and_pool(spark):
    df = spark.createDataFrame(
        [("a", "stock news today", "@Reuters", 10, None), ("b", "cat pictures", None, 100000, 5),
         ("c", "viral football meme", "x", 0, 0), ("d", "stock", None, 10, None)],
        "tweet_id string, text string, author_username string, like_count int, retweet_count int")
    assert [r["tweet_id"] for r in R.ranked(df, 3).collect()] == ["a", "d", "b"]
    assert [R.pool_size(n) for n in (1, 5, 6, 10, 11, 99)] == [10, 10, 15, 15, 20, 20]
    assert [R.clamp_results(n) for n in (1, 3, 25, 100)] == [3, 3, 25, 25]


# ---- saved searches, checked by brute force ----

def _brute(posts, spec):
    import re
    import unicodedata

    def key(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        return " " + " ".join(re.findall(r"[a-z0-9$]+", s)) + " "

    out = set()
    for p in posts:
        k, handle = key(p["text"]), (p["author_username"] or "").lower().lstrip("@")
        ok = all(any(key(t) in k for t in clause) for clause in spec["clauses"])
        ok &= not any(key(t) in k for t in spec["excluded_terms"])
        ok &= spec["lang"] is None or spec["lang"] == p["lang"]
        ok &= spec["only_authors"] is None or handle in [a.lower() for a in spec["only_authors"]]
        ok &= handle not in [a.lower() for a in spec["excluded_authors"]]
        if ok and not p["text"].startswith("RT @"):
            out.add(p["tweet_id"])
    return out


def test_searches_equal_brute_force(spark):
    texts = ["Nvidia stock up", "NVDA data  center", "nvidia data", "RT @a nvidia stock", "Nvidia stock giveaway",
             "Free crypto nvidia stock", "Banco de México sube tasas", "banxico y la inflación",
             "moody's downgrade of Mexico", "peso mexicano", "$NVDA shares", "nvdax shares", "", "AI chips earnings"]
    handles = ["Reuters", None, "zerohedge", "x"]
    data = [(str(i), t, "es" if i in (6, 7, 9) else "en", handles[i % 4], i) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(data, "tweet_id string, text string, lang string, author_username string, o int")
    asked = spark.createDataFrame(
        [(1, "Nvidia AI chips"), (2, "Mexico Moody"), (3, "Banxico tasa inflación"), (4, "stock outlook")],
        "question_id int, question string")
    specs = S.precise_searches(asked).select("question_id", *S.SEARCH_FIELDS)
    for scope in ("broad_all_x", "curated_accounts"):
        specs = specs.unionByName(S.broad_searches(asked, scope=scope).select("question_id", *S.SEARCH_FIELDS))
    specs = S.with_search_key(specs.unionByName(S.loose_searches(asked).select("question_id", *S.SEARCH_FIELDS)))
    found = {}
    for r in S.match_searches(posts, specs).collect():
        found.setdefault(r["search_key"], set()).add(r["tweet_id"])
    plain = [r.asDict() for r in posts.collect()]
    for spec in specs.collect():
        assert found.get(spec["search_key"], set()) == _brute(plain, spec.asDict()), spec
    assert any(found.values())


def test_company_search_is_strict_about_tickers(spark):
    good = S.company_searches(spark.createDataFrame([("bbva",)], "ticker string"), language="es", curated=False).first()
    assert good["lang"] == "es" and good["clauses"][0][0] == "BBVA" and len(good["clauses"][1]) == 10
    assert good["excluded_authors"] == ["WatcherGuru", "WhaleChart", "zerohedge"]
    with pytest.raises(Exception, match="not configured"):
        S.company_searches(spark.createDataFrame([("NOPE",)], "ticker string")).collect()


def test_allocation():
    assert S.allocation(25, "broad_all_x") == (15, 10)
    assert S.allocation(10, "broad_all_x") == (10, 0)
    assert S.allocation(25, "curated_accounts") == (25, 0)


# ---- aggregates ----

def test_gold_daily_traps(spark):
    df = spark.createDataFrame(
        [("2026-05-20 10:00:00", "NVDA", "positive"), ("2026-05-20 11:00:00", "NVDA", "negative"),
         (None, "NVDA", "neutral"), ("2026-05-21 00:00:00", None, "other"), ("2026-05-22 00:00:00", "V", None)],
        "created_at string, primary_ticker string, sentiment string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert rows(A.gold_daily(df), "ticker", "created_date", "positive", "neutral", "negative", "total", "neg_ratio") == [
        ("NVDA", "2026-05-20", 1, 0, 1, 2, 0.5), ("NVDA", "NaT", 0, 1, 0, 1, 0.0),
        ("UNMAPPED", "2026-05-21", 0, 0, 0, 0, 0.0)]


def test_trend_fills_only_its_own_range(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "positive"), ("2024-01-04", "positive"), ("2024-01-02", "negative"), (None, "negative"),
         ("2024-01-02", None)], "d string, sentiment string").withColumn("created_at", F.col("d").cast("timestamp"))
    got = [(r[0], str(r[1])[:10], r[2]) for r in A.sentiment_trend(df).orderBy("sentiment", "created_at").collect()]
    assert got == [("negative", "2024-01-02", 1), ("positive", "2024-01-01", 1), ("positive", "2024-01-02", 0),
                   ("positive", "2024-01-03", 0), ("positive", "2024-01-04", 1)]
    assert (None in {r["sentiment"] for r in A.daily_trend(df).collect()})


def test_ratios_of_nothing(spark):
    df = spark.createDataFrame([], "tickers array<string>, primary_ticker string, sentiment string")
    assert A.by_mentioned_ticker(df).count() == 0
    assert A.overview(df).first()["positive_ratio"] is None
    with pytest.raises(ValueError):
        A.ticker_ranking(df, "nonsense")


# ---- retrieval ----

def _corpus(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, clean_text string")


def test_tfidf_equals_numpy(spark):
    docs = ["nvidia gpu growth is strong strong", "tesla margin risk and volatility", "gpu margin growth", "the and or"]
    index = G.build_index(_corpus(spark, *docs))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in index.postings.collect()}
    grams = []
    for d in docs:
        w = [x for x in d.split() if x not in ("is", "and", "the", "or")]
        grams.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for i, g in enumerate(grams):
        weight = {t: g.count(t) * (np.log((1 + len(docs)) / (1 + sum(t in o for o in grams))) + 1) for t in set(g)}
        norm = np.sqrt(sum(v * v for v in weight.values()))
        for t, v in weight.items():
            assert abs(got.pop((str(i), t)) - v / norm) < 1e-12
    assert not got


def test_search(spark):
    corpus = _corpus(spark, "NVIDIA GPU orders (NVDA) keep growing", "volatility and thin margins at Tesla (TSLA)")
    asked = spark.createDataFrame([(1, "NVIDIA GPU"), (2, "the"), (3, "")], "question_id int, question string")
    hits = G.search_index(G.build_index(corpus), asked, k=1)
    assert rows(hits, "question_id", "doc_id", "rank") == [(1, "0", 1)]
    assert G.build_index(_corpus(spark, "the and or")).postings.count() == 0


def test_vocabulary_cut_prefers_frequent_then_alphabetical(spark):
    index = G.build_index(_corpus(spark, "bb aa", "cc cc"), max_features=2)
    assert rows(index.vocabulary, "term") == [("aa",), ("cc",)]


@pytest.mark.parametrize("block", [2, 1024])
def test_vector_search_equals_numpy(spark, block):
    rng = np.random.default_rng(5)
    data, asked = rng.normal(size=(50, 8)), rng.normal(size=(5, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, query array<double>")
    got = rows(G.vector_search(vectors.repartition(3), queries, k=4, block=block), "query_id", "rank", "vec_id")
    data = data.astype(np.float32).astype(float)
    cos = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (data / np.linalg.norm(data, axis=1, keepdims=True)).T
    want = [(q, r + 1, int(v)) for q in range(5) for r, v in enumerate(np.argsort(-cos[q])[:4])]
    assert got == sorted(want, key=repr)


# ---- sources ----

def test_tables_by_extension(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc\\", ["x"]), ("", None)], "t string, l array<string>")
    path = tables.write_table(df, f"{tmp_path}/x.CSV")
    back = tables.read_table(spark, path)
    # an empty CSV cell is a missing value
    assert rows(back, "t") == [("a,\"b\"\nc\\",), (None,)]
    assert tables.read_table(spark, tables.write_table(df, f"{tmp_path}/y.parquet")).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.json")


def _payload(i, users):
    return {"data": [{"id": str(i), "text": "NVDA stock earnings beat the market again", "created_at": "2026-05-20T10:00:00Z",
                      "author_id": "u1", "public_metrics": {"like_count": i}},
                     {"id": f"{i}b", "author_id": "nobody"}],
            "includes": {"users": users}}


def test_flatten_payload(spark, tmp_path):
    folder = tmp_path / "ingestion_date=2026-05-20"
    folder.mkdir()
    users = [{"id": "u1", "username": "old"}, {"id": "u1", "username": "Reuters", "public_metrics": {"followers_count": 7}}]
    (folder / "twitter_live_nvda_1.json").write_text(json.dumps(_payload(1, users), indent=1))
    got = payloads.flatten_payload(payloads.read_payloads(spark, str(tmp_path)), keep=("run_id", "run_ticker", "ingestion_date"))
    assert rows(got, "tweet_id", "text", "author_username", "author_followers", "like_count", "run_ticker") == [
        ("1", "NVDA stock earnings beat the market again", "Reuters", 7, 1, "NVDA"), ("1b", "", None, None, None, "NVDA")]
    both = {"user_query": "q", "queries": ["first"], "responses": [_payload(1, []), _payload(2, [])], "strategy": "s"}
    (folder / "c.json").write_text(json.dumps(both))
    flat = payloads.flatten_combined(payloads.read_payloads(spark, str(folder / "c.json"), combined=True))
    assert rows(flat, "tweet_id", "query") == [("1", "first"), ("1b", "first")]


def test_schema_inference(spark):
    posts = ["$TSLA opens lower, few deliveries are expected", "$NVDA is up, AI chip demand stays strong"]
    a = spark.createDataFrame([(p, i) for i, p in enumerate(posts)], "text string, label int")
    m = schema.infer_mapping(a, "label")
    assert (m.text_column, m.method, m.label_column) == ("text", "rules", "label") and m.confidence >= 0.8
    b = spark.createDataFrame([("Traders talk of chip demand and of AI revenue", "A note on earnings and on stock volatility")],
                              "alpha string, beta string")
    assert (schema.infer_mapping(b).text_column, schema.infer_mapping(b).method) == (None, "ambiguous")
    assert schema.infer_mapping(a.filter("false")).method == "rules"
    one = spark.createDataFrame([(posts[0] + " and revenue",)], "content string")
    assert schema.infer_mapping(one).confidence == 0.95
    assert schema.name_score("body") == 0.0 and schema.name_score("sentiment") == -14.0
    with pytest.raises(ValueError):
        schema.standardize(b, schema.infer_mapping(b), source_file="x", processed_at="now")


def test_text_fallback(spark):
    assert schema.ensure_text_column(spark.createDataFrame([("x",)], "body string")).first()["text"] == "x"
    assert schema.ensure_text_column(spark.createDataFrame([("x",)], "other string")).count() == 0


def test_lake_roundtrip_rerun_and_pruning(spark, tmp_path):
    df = E.process_posts(spark.createDataFrame([("1", "Tesla gains"), ("2", "Apple risk")], "tweet_id string, text string"),
                         run_ts="2026-05-20 10:00:00")
    root = str(tmp_path)
    for run in ("r1", "r1", "r2"):
        paths = lake.write_lake(df, root, source="manual_upload", run_id=run, ingestion_date="2026-05-20")
    silver = lake.read_silver(spark, root)
    assert silver.count() == 4 and paths["gold"] and lake.read_gold(spark, root).count() == 4
    assert silver.columns == [f.name for f in lake.SILVER.fields]
    plan = silver.filter("source = 'manual_upload' AND ingestion_date >= '2026-05-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan
    empty = lake.write_lake(df.filter("false"), root, source="manual_upload", run_id="r3", ingestion_date="2026-05-20")
    assert empty["gold"] is None
    spark.sql(lake.table_ddl("silver_ext", lake.SILVER, f"{root}/{lake.SILVER_PATH}"))
    spark.sql("MSCK REPAIR TABLE silver_ext")
    assert spark.table("silver_ext").filter("run_id = 'r2'").count() == 2


def test_conform_silver_bad_dates_are_null(spark):
    df = spark.createDataFrame([("9", "garbage")], "doc_id string, created_at string")
    row = lake.conform_silver(df, source="twitter_live", run_id="r", ingestion_date="d").first()
    assert row["tweet_id"] == "9" and row["created_at"] is None and row["text"] == "" and row["is_noise"] is False


# ---- incremental ----

def test_latest_variants(spark):
    old = spark.createDataFrame([("1", "2024-01-01", 1), ("2", None, 2)], "tweet_id string, created_at string, o int")
    new = spark.createDataFrame([("1", "2024-01-03", 3), ("3", "2024-01-02", 4)], old.schema)
    assert [r["tweet_id"] for r in L.latest(old, new, order="o", n=2).collect()] == ["1", "3"]
    assert [r["tweet_id"] for r in L.latest_tail(old, new, order="o", n=2).collect()] == ["2", "1"]
    assert L.latest(None, new, order="o").count() == 2


def test_ticker_window(spark):
    df = spark.createDataFrame([(0,), (7199,), (7200,), (14400,)], "s long")
    got = df.select(L.ticker_for_window(F.timestamp_seconds("s"), ["a ", "b"])).collect()
    assert [r[0] for r in got] == ["A", "A", "B", "A"]
    with pytest.raises(ValueError):
        L.ticker_for_window(F.lit(None), [])


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing = tmp_path / "landing" / "ingestion_date=2026-05-20"
    landing.mkdir(parents=True)
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "progress")
    users = [{"id": "u1", "username": "Reuters"}]

    def ingest():
        live.run_live_ingestion(spark, str(tmp_path / "landing"), root, checkpoint, run_ts="2026-05-21 00:00:00",
                                source_options={"maxFilesPerTrigger": "1"})

    for i in (1, 2):
        (landing / f"twitter_live_nvda_{i}.json").write_text(json.dumps(_payload(i, users)))
    ingest()
    assert rows(lake.read_silver(spark, root), "tweet_id", "run_id") == [("1", "twitter_live_nvda_1"), ("2", "twitter_live_nvda_2")]
    (landing / "twitter_live_nvda_3.json").write_text(json.dumps(_payload(3, users)))
    (landing / "twitter_live_nvda_4.json").write_text(json.dumps({"data": [{"id": "n", "text": "giveaway"}]}))
    ingest()
    silver = lake.read_silver(spark, root)
    assert silver.count() == 3
    flat = payloads.flatten_payload(
        payloads.read_payloads(spark, str(tmp_path / "landing")), query_ticker=F.col("run_ticker"), keep=live.LINEAGE)
    batch = live.relevant_silver(flat, run_ts="2026-05-21 00:00:00")
    same = ["tweet_id", "text", "sentiment", "topic", "is_noise", "relevance_score", "run_id"]
    assert rows(silver, *same) == rows(batch, *same)
    assert rows(live.read_latest(spark, root, lake.SILVER), "tweet_id") == [("1",), ("2",), ("3",)]
    assert lake.read_gold(spark, root).agg(F.sum("total")).first()[0] == 3


def test_batch_job_and_upload(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    tables.write_table(spark.createDataFrame(
        [("Google gains today, its cloud revenue was above all forecasts", "0"),
         ("Tesla stock is down, investors dislike the margins", "1")], "content string, label string"), path)
    out = jobs.run_batch(spark, path, f"{tmp_path}/out.parquet", run_ts="2026-05-20 00:00:00")
    assert rows(spark.read.parquet(out), "primary_ticker", "source_file") == [("GOOGL", "in.csv"), ("TSLA", "in.csv")]
    up = jobs.ingest_upload(spark, path, f"{tmp_path}/lake", run_id="up1", run_ts="2026-05-20 00:00:00", base=spark.read.parquet(out))
    assert up.corpus.count() == 2 and up.paths["gold"]
    with pytest.raises(ValueError):
        jobs.reprocess_table(spark, out, out, stamp="x")
    assert jobs.reprocess_table(spark, out, f"{tmp_path}/re.parquet", stamp="x", dry_run=True).count() == 2
