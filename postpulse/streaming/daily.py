"""Daily sentiment by ticker, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.sentiment import LABELS, count_label
from postpulse.functions.tickers import UNMAPPED


def daily_counts(silver: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Tumbling one-day counts per ticker over a stream of silver rows.

    Repeats of an id within the watermark are counted once; rows later than the
    watermark are dropped; a day is emitted (append mode) when the watermark passes it.
    As in the batch form, a bucket whose labels are all null has no row.
    """
    unique = silver.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["tweet_id"])
    return (
        unique.filter(F.col("sentiment").isNotNull()).groupBy(
            F.window("created_at", "1 day").alias("w"),
            F.coalesce("primary_ticker", F.lit(UNMAPPED)).alias("ticker"),
        )
        .agg(*[count_label(label).alias(label) for label in LABELS])
        .select(
            "ticker", F.date_format("w.start", "yyyy-MM-dd").alias("created_date"), *LABELS,
            (F.col("positive") + F.col("neutral") + F.col("negative")).alias("total"),
        )
    )


def run_daily_counts(silver: DataFrame, path: str, checkpoint: str, lateness: str = "2 days") -> None:
    """Process what is there, append finished days to ``path``, stop."""
    query = (
        daily_counts(silver, lateness)
        .writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
