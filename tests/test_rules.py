"""Row rules on hand-written texts, including the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from postpulse.functions import anchors, authors, overrides, questions, sentiment, text, tickers, topics
from postpulse.operators import enrich

T = F.col("t")


def test_clean_text(texts):
    got = texts(
        text.clean_text(T), "@reader $NVDA is up https://example.com/a on demand", None,
        "@someone", "WWW.Site.com/x  only\n\nlines   here", "#tag @ñandú_1 ok",
    )
    assert got == ["$NVDA is up on demand", "", "", "only lines here", "#tag ok"]


def test_clean_text_legacy_deletes_instead_of_blanking(texts):
    assert texts(text.clean_text_legacy(T), "up 🚀 #moon @me http://a.b now", "a#b") == ["up now", "a"]


def test_fold(texts):
    assert texts(text.fold(T), "CALIFICACIÓN Ñandú", "plain ASCII", "straße ﬁ é") == [
        "calificacion nandu", "plain ascii", "straße ﬁ e"]


def test_tickers(texts):
    got = texts(
        tickers.extract_tickers(T), "$NVDA and Apple are ahead in AI, then comes Microsoft.",
        "melon pineapple laws", "jpm rises", "xjpmx", "$TOOLONGX", "$TSLA1", "",
    )
    assert got == [["AAPL", "MSFT", "NVDA"], ["AAPL", "AMZN", "TSLA"], ["JPM"], [],
                   [], ["TSLA"], []]


def test_primary_ticker(texts):
    assert texts(tickers.primary_ticker(tickers.extract_tickers(T)), "Tesla and Apple", "none") == [
        "AAPL", "UNMAPPED"]


def test_tickers_legacy_keeps_order_and_repeats(texts):
    assert texts(tickers.extract_tickers_legacy(T), "TSLA FED $NVDA TSLA A ABCDEFG Abc ABé") == [
        ["TSLA", "NVDA", "TSLA", "CDEFG"]]


@pytest.mark.parametrize("value,label,pos,neg", [
    ("NVDA had strong growth and a record profit", "positive", 4, 0),
    ("TSLA: decline, risk, losses, volatility", "negative", 0, 4),
    ("no no risk", "positive", 1, 0),
    ("not", "neutral", 0, 0),
    ("", "neutral", 0, 0),
    ("not very strong", "positive", 1, 0),
    ("never sell strong", "positive", 2, 0),
    ("Récord CAÍDA", "neutral", 1, 1),
])
def test_lexicon(texts, value, label, pos, neg):
    row = texts(sentiment.lexicon_sentiment(T), value)[0]
    assert (row["sentiment"], row["positive_hits"], row["negative_hits"]) == (label, pos, neg)


def test_lexicon_score_is_divided_by_root_of_all_tokens(texts):
    filler = " word" * 15
    rows = texts(sentiment.lexicon_sentiment(T), "gain" + filler, "gain" + filler + " word", "gain" + " x" * 1023)
    assert [r["sentiment"] for r in rows] == ["positive", "neutral", "neutral"]
    assert [r["sentiment_score"] for r in rows] == [0.25, round(1 / 17**0.5, 4), round(1 / 32, 4)]


def test_topics(texts):
    got = texts(
        topics.classify_topic(T), "México queda en Baa3: Moody’s recorta su calificación crediticia",
        "La tasa de interés de Banxico no cambia, la inflación sigue",
        "Comunicado de Hacienda: la calificación soberana de México",
        "More spending on AI data centers, more GPU orders at Nvidia",
        "downgrade with new price target", "corporate cut", "moody's", "said hacienda", None,
    )
    assert got == ["sovereign_credit_rating", "monetary_policy", "sovereign_credit_rating", "ai_chips",
                   "sovereign_credit_rating", "monetary_policy", "sovereign_credit_rating",
                   "general_market", "general_market"]


def test_topic_by_label(spark):
    df = spark.createDataFrame([(0, None), (19, None), (20, "x"), (-1, None), (None, "x"), (None, None)],
                               "l int, m string")
    got = [r[0] for r in df.select(topics.topic_by_label(F.col("l"), F.col("m"))).collect()]
    assert got == ["Analyst Update", "USD", "Unknown", "Unknown", "x", "Unknown"]


def test_overrides(spark):
    rows = [
        ("Moody recorta a México", "general_market", "positive", 0.5),
        ("nota soberana mejora", "earnings", "neutral", None),
        ("calificación", "earnings", "positive", float("nan")),
        ("Banxico decide", "ai_chips", "neutral", 0.3),
        ("Banxico decide", "earnings", "neutral", None),
        ("trabaja en moody", "", "positive", 0.99),
    ]
    df = spark.createDataFrame(rows, "text string, topic string, sentiment string, sentiment_confidence double")
    got = [tuple(r) for r in overrides.apply_overrides(df).select("topic", "sentiment", "sentiment_confidence").collect()]
    assert got == [
        ("sovereign_credit_rating", "negative", 0.88), ("sovereign_credit_rating", "positive", 0.75),
        ("sovereign_credit_rating", "neutral", 0.70), ("monetary_policy", "neutral", 0.3),
        ("earnings", "neutral", None), ("sovereign_credit_rating", "negative", 0.99),
    ]


def test_author_tiers(texts):
    names = ["PeterLBrandt", "Banxico", "@Reuters", "SomeRandomUser", "Stocktwits", "bespokeinvest",
             "zerohedge", None, ""]
    assert texts(authors.author_tier(T), *names) == [
        "trader_influencer", "institution", "financial_media", "unknown", "financial_media",
        "market_research", "high_noise_watchlist", "unknown", "unknown"]
    assert texts(authors.is_curated(T), "zerohedge", "Reuters", None) == [False, True, False]


def test_company_inference(texts):
    assert texts(tickers.infer_company(T), "Tesla va mal?", "Nvidia AI chips", "V for victory", "victory",
                 "coincidence", "a discussion", "") == ["TSLA", "NVDA", "V", None, "COIN", "DIS", None]


def test_question_features(texts):
    q = "¿creen que la tasa de interés en México va a subir?"
    assert texts(questions.language_hint(T), q, "stock outlook") == ["es", "en"]
    assert texts(questions.is_macro(T), q, "Apple sales") == [True, False]
    assert texts(questions.search_terms(T, "es"), q)[0][:3] == ["creen", "interés", "México"]
    assert texts(questions.search_terms(T, "en"), "what about the $NVDA NVDA $nvda ai trump")[0] == [
        "$NVDA", "NVDA", "$nvda", "trump", "Trump", "tariffs", "markets", "rates", "geopolitics"]


def test_anchor_traps(texts):
    names = anchors.names(anchors.anchor_groups(T))
    got = texts(names, "s&p cuts", "BB+ rating", "bb- note", "china tariff", "Mexico Moody", "federal", "", None)
    assert got == [[], ["rating_codes"], ["rating_codes"], ["china", "geopolitical"], ["moody", "mexico"],
                   [], [], []]


def test_required_anchors(texts):
    g = anchors.with_implied_context(anchors.anchor_groups(T))
    assert texts(anchors.required_count(g), "Mexico Moody", "Google antitrust DOJ", "oil", "hello",
                 "Mexico Moody Baa3") == [3, 2, 1, 0, 2]


def test_refinement(texts):
    rows = texts(questions.refine(T), "", "Google antitrust DOJ", "tell me about google", "the stock", "weather")
    assert [r["reason"] for r in rows] == [
        "empty query", "strong_anchors_preserved", "expanded entity 'google' with finance terms",
        "already has financial context", "added generic financial context"]
    assert rows[4]["refined"].startswith("(weather) (mercado OR")
    corpus = texts(questions.refine_for_corpus(T), "weather", "the stock")
    assert corpus[0]["refined"].startswith("weather mercado mercados") and " OR " not in corpus[0]["refined"]
    assert corpus[1]["refined"] == "the stock"


def test_rewrite_candidate(texts):
    assert texts(overrides.rewrite_candidate(T), "peso sube", "stock up", "stock café", "hola") == [
        True, False, True, False]


def test_missing_columns_are_errors(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for fn in (enrich.with_lexicon_sentiment, enrich.process_posts):
        with pytest.raises(ValueError):
            fn(df)
