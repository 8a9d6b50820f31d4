"""A preview writes each found post once, and its pairs of questions and posts without texts."""

from postpulse.plans import jobs

ASKED = "Tesla shares fall"
POSTS = "ord int, tweet_id string, text string, author_username string, lang string, like_count int, created_at string"


def _rows(spark):
    text = "Tesla shares drop on weak demand and margin loss $TSLA"
    return spark.createDataFrame([
        (2, "a", text + " again", "reuters", "en", 1, "2024-01-02 00:00:00"),
        (1, "a", text, "reuters", "en", 1, "2024-01-02 00:00:00"),  # the same id: the smaller ord is taken
        (3, "b", text + " and more", None, "en", None, "2024-01-03 00:00:00"),
        (4, "c", "lovely weather today for everyone here", "x", "en", 2, "2024-01-03 00:00:00"),
    ], POSTS)


def test_pairs_have_no_texts_and_posts_are_processed_once(spark, monkeypatch):
    written, kept = {}, jobs.materialize

    def watch(df, name):
        out = kept(df, name)
        written[name] = out
        return out

    monkeypatch.setattr(jobs, "materialize", watch)
    questions = spark.createDataFrame([(1, ASKED), (2, ASKED), (2, ASKED), (3, "")], "question_id bigint, question string")
    result = jobs.preview(_rows(spark), questions, run_ts="2024-02-01 00:00:00")
    assert "text" not in written["preview"].columns
    assert sorted(r["tweet_id"] for r in written["preview-posts"].collect()) == ["a", "b"]
    raw = sorted((r["question_id"], r["tweet_id"], r["ord"], r["live_search_query"]) for r in result.raw.collect())
    assert raw == sorted([(q, t, o, ASKED) for q in (1, 2, 2) for t, o in (("a", 1), ("b", 3))])
    shown = sorted((r["question_id"], r["tweet_id"], r["doc_id"], r["text"]) for r in result.relevant.collect())
    texts = {r["tweet_id"]: r["text"] for r in result.raw.collect()}
    assert shown == [(q, t, f"{q}\u0001{t}", texts[t]) for q in (1, 2) for t in ("a", "b")]
