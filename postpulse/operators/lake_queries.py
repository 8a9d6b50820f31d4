"""The published lake queries.  The day counted back from is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.operators.joins import top_k


def _since(as_of: str, days: int) -> Column:
    """Partition-column predicate; constant-folded, so it prunes partitions."""
    return F.col("ingestion_date") >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")


def _newest() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("tweet_id").asc_nulls_last()]


def recent_live(silver: DataFrame, as_of: str, days: int = 7, k: int = 100) -> DataFrame:
    rows = silver.filter((F.col("source") == "twitter_live") & _since(as_of, days)).select(
        "tweet_id", "created_at", "query_ticker", "primary_ticker", "author_username", "sentiment",
        "sentiment_model", "topic", "text",
    )
    return top_k(rows, k, _newest()).drop("tweet_id")


def _sums() -> list[Column]:
    return [
        F.sum("total").alias("total_mentions"),
        F.sum("positive").alias("positive_mentions"),
        F.sum("neutral").alias("neutral_mentions"),
        F.sum("negative").alias("negative_mentions"),
    ]


def _neg_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "neg_ratio", F.try_divide(F.col("negative_mentions") * F.lit(1.0), F.col("total_mentions"))
    )


def gold_window(gold: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Re-summed gold of the last days by ticker and day; a post captured by two runs
    counts twice, as gold is per run."""
    return _neg_ratio(gold.filter(_since(as_of, days)).groupBy("ticker", "created_date").agg(*_sums()))


def manual_uploads(silver: DataFrame) -> DataFrame:
    return (
        silver.filter(F.col("source") == "manual_upload").groupBy("primary_ticker", "sentiment")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def live_without_noise(silver: DataFrame, k: int = 100) -> DataFrame:
    """Here an unlabelled row counts as not noise."""
    rows = silver.filter(
        (F.col("source") == "twitter_live") & ~F.coalesce(F.col("is_noise"), F.lit(False))
    ).select(
        "tweet_id", "created_at", "author_username", "primary_ticker", "query_ticker", "sentiment",
        "sentiment_confidence", "topic", "relevance_score", "text",
    )
    return top_k(rows, k, _newest()).drop("tweet_id")


def gold_listing(gold: DataFrame, sources: tuple[str, ...] = ("twitter_live", "manual_upload")) -> DataFrame:
    return gold.filter(F.col("source").isin(list(sources))).select(
        "source", "ticker", "created_date", "total", "positive", "neutral", "negative",
        "pos_ratio", "neu_ratio", "neg_ratio",
    ).orderBy(F.col("created_date").desc_nulls_last(), "source", "ticker")


def live_versus_batch(gold: DataFrame) -> DataFrame:
    return _neg_ratio(gold.groupBy("source", "ticker").agg(*_sums()))
