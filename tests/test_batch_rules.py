"""Long term lists are searched in batches, one reading of a text for a list; and inputs once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postpulse.functions import anchors, overrides, text as X
from postpulse.operators import aggregates as A, enrich as E, relevance as R


def _texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def test_hits(spark):
    patterns = [X.any_substring(["a+b", "credit risk"]), "", X.any_token(["fx", "$v", "s&p"], "a-z0-9$"),
                X.any_substring(["credit risk"], loose=True)]
    got = _texts(spark, ["xa+bx fx", "credit\n risk", "credit risk,$v", "fxs $vx s&p", None, ""]).select(
        "i", X.hits(F.col("text"), patterns).alias("h"))
    assert {r.i: r.h for r in got.collect()} == {0: [0, 2], 1: [3], 2: [0, 2, 3], 3: [], 4: None, 5: []}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def _substring_tests(df) -> int:
    return len(re.findall(r"(?<!array_)contains\(", _plan(df)))


def test_anchors_read_a_text_once(spark):
    df = _texts(spark, ["Moody's\tand  S&P cut México to BB+", "tipo\n de  cambio", None])
    got = df.select("i", anchors.names(anchors.anchor_groups(F.col("text"), with_implied=True)).alias("n"))
    assert {r.i: r.n for r in got.collect()} == {0: ["moody", "rating_codes", "mexico"], 1: ["fx"], 2: []}
    assert _substring_tests(got) == 0


def test_overrides_labels_and_ranking_read_a_text_once(spark):
    df = _texts(spark, ["Fitch upgrade", "banxico tasas", "viral meme stock", None]).withColumns(
        {"tweet_id": F.col("i").cast("string"), "topic": F.lit(""), "sentiment": F.lit("neutral")})
    got = overrides.apply_overrides(df)
    assert [(r.topic, r.sentiment) for r in got.orderBy("i").collect()] == [
        ("sovereign_credit_rating", "positive"), ("monetary_policy", "neutral"), ("", "neutral"), ("", "neutral")]
    ranking = R.with_engagement_ranking(df)
    assert [r.noise_penalty for r in ranking.orderBy("i").collect()] == [0.0, 0.0, -120.0, 0.0]
    for frame in (got, ranking):
        assert _substring_tests(frame) == 0


@pytest.mark.parametrize("value, clean", [
    ("\U0001f600 up http://x.y #tag @me now", "up now"), ("#a", ""), ("httpx", ""), ("plain  text", "plain text"),
    ("é ☀ ok", "é ok"), (None, "")])
def test_legacy_cleaning_skips_what_cannot_match(spark, value, clean):
    df = _texts(spark, [value]).select(X.clean_text_legacy(F.col("text")).alias("c"))
    assert df.first()["c"] == clean
    assert "octet_length" in _plan(df)


def test_summary_facts_evaluate_their_rows_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def seen(values: pd.Series) -> pd.Series:
        asked.add(len(values))
        return pd.Series(np.where(values == 0, "positive", "negative"))

    rows = spark.range(3).select(
        F.lit("d").alias("day"), F.lit("NVDA").alias("primary_ticker"), F.repeat(F.lit("x"), 300).alias("text"),
        seen.asNondeterministic()("id").alias("sentiment"), F.col("id").alias("rank"))
    got = A.summary_facts(rows, [F.col("rank")], "day").collect()
    assert [(r.posts, r.dominant, len(r.evidence)) for r in got] == [(3, "negative", 3 * 222 + 2)]
    assert asked.value == 3


def test_topic_shift_processes_posts_once(spark, tmp_path):
    from postpulse.plans.registry import QUERIES, RUN_TS, processed

    spark.range(40).selectExpr(
        "id as event_id", "id % 7 as user_id", "timestamp_seconds(1704067200 + id * 3600) as ts", "'view' as event_type",
        "cast(id % 5 as double) as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(10).selectExpr(
        "id as doc_id", "concat('the oil price ', id) as text", "'en' as lang", "'web' as source", "id as n_chars",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["F20_topic_shift"](spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    before = processed(spark, str(tmp_path)).withColumn("topic", F.when(F.col("ord") % 4 != 0, F.col("topic")))
    wanted = A.topic_shift(before, E.reprocess(before, RUN_TS))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
