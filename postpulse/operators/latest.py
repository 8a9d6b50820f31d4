"""Latest-N snapshot, run windows and backfill selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.functions.text import string_array
from postpulse.operators.joins import keep_last, spread_join, top_k

LATEST_ROWS = 1000
BACKFILL_ROWS = 500


def _latest_by_id(existing: DataFrame | None, new: DataFrame, order: str) -> DataFrame:
    if existing is None:
        both = new.withColumn("_side", F.lit(1))
    else:
        both = existing.withColumn("_side", F.lit(0)).unionByName(
            new.withColumn("_side", F.lit(1)), allowMissingColumns=True
        )
    key = "tweet_id" if "tweet_id" in both.columns else "text"
    return keep_last(both, [key], ["_side", order]).drop("_side")


def latest(existing: DataFrame | None, new: DataFrame, *, order: str, n: int = LATEST_ROWS) -> DataFrame:
    """Newest ``n`` posts after an upsert; undated posts come last."""
    return top_k(
        _latest_by_id(existing, new, order), n,
        [F.col("created_at").desc_nulls_last(), F.col(order).asc()],
    )


def latest_tail(existing: DataFrame | None, new: DataFrame, *, order: str, n: int = BACKFILL_ROWS) -> DataFrame:
    """The backfill's variant: the tail of an ascending sort with undated posts at the
    end, so undated posts are kept in preference."""
    return top_k(
        _latest_by_id(existing, new, order), n,
        [F.col("created_at").desc_nulls_first(), F.col(order).desc()],
    )


def ticker_for_window(ts: Column, tickers: Sequence[str], hours: int = 2) -> Column:
    """Round-robin assignment of a ticker to each window of ``hours``."""
    if not tickers:
        raise ValueError("at least one ticker is needed")
    window = F.floor(F.unix_timestamp(ts) / F.lit(hours * 3600))
    position = F.pmod(window, F.lit(len(tickers))).cast("int")
    return F.get(string_array([t.upper().strip() for t in tickers]), position)


def missing_runs(bronze: DataFrame, silver: DataFrame, *, since: str, until: str, force: bool = False) -> DataFrame:
    """Bronze rows of a date range whose run has no silver output yet.

    Runs are reduced to their names on both sides before they meet, and the bronze
    rows join the (few) missing names.
    """
    in_range = bronze.filter(F.col("ingestion_date").between(since, until))
    if force:
        return in_range
    done = silver.select("run_id").distinct()
    missing = in_range.select("run_id").distinct().join(done, "run_id", "left_anti")
    return spread_join(in_range, missing, ["run_id"], "left_semi")


def backfill_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_noise": F.lit(False),
        "relevance_score": F.lit(0.75),
        "noise_reason": F.lit("bronze_backfill_no_relevance_recheck"),
        "is_curated_market_author": F.lit(None).cast("boolean"),
        "author_reliability_tier": F.lit("unknown"),
    })
