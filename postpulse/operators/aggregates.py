"""Aggregates behind the dashboards.  All are one hash aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postpulse.functions.sentiment import LABELS, count_label
from postpulse.functions.tickers import UNMAPPED
from postpulse.operators.joins import top_k
from postpulse.session import materialize

NO_DATE = "NaT"


def _counts() -> list[Column]:
    return [count_label(label).alias(label) for label in LABELS]


def _total() -> Column:
    return F.col("positive") + F.col("neutral") + F.col("negative")


def _ratio(column: str, total: Column | None = None) -> Column:
    total = F.col("total") if total is None else total
    return F.col(column) / F.when(total == 0, 1).otherwise(total)


def day_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def gold_daily(silver: DataFrame, lineage: Sequence[str] = ("source", "ingestion_date", "run_id")) -> DataFrame:
    """Daily sentiment by ticker, one row per lineage value present.

    A post without a date falls into the bucket 'NaT'; a bucket whose labels are
    all null has no row; a label outside the three classes is in no count.
    """
    keys = [c for c in lineage if c in silver.columns]
    return (
        silver.select(
            *keys,
            F.coalesce(F.col("primary_ticker"), F.lit(UNMAPPED)).alias("ticker"),
            F.coalesce(day_of(F.col("created_at")), F.lit(NO_DATE)).alias("created_date"),
            "sentiment",
        )
        .groupBy(*keys, "ticker", "created_date")
        .agg(*_counts(), F.count("sentiment").alias("_labelled"))
        .filter(F.col("_labelled") > 0)
        .drop("_labelled")
        .withColumn("total", _total())
        .withColumns({"pos_ratio": _ratio("positive"), "neg_ratio": _ratio("negative"),
                      "neu_ratio": _ratio("neutral")})
    )


def gold_by_source(df: DataFrame, ingestion_date: str) -> DataFrame:
    """Gold keyed by (source, ticker, day); the ingestion date stands in for a missing
    ``created_at`` column, the query ticker for a missing ``primary_ticker`` column."""
    ticker = next((c for c in ("primary_ticker", "query_ticker") if c in df.columns), None)
    named = df.withColumn("primary_ticker", F.col(ticker) if ticker else F.lit(UNMAPPED))
    if "created_at" not in df.columns:
        named = named.withColumn("created_at", F.lit(ingestion_date).cast("timestamp"))
    return gold_daily(named, ("source",)).withColumn("ingestion_date", F.lit(ingestion_date))


def by_mentioned_ticker(df: DataFrame, min_mentions: int = 1) -> DataFrame:
    """A post counts once for every ticker it mentions."""
    return (
        df.select(F.explode("tickers").alias("tickers"), "sentiment")
        .filter(F.length("tickers") > 0)
        .groupBy("tickers").agg(*_counts(), F.count("sentiment").alias("_labelled"))
        .filter(F.col("_labelled") > 0).drop("_labelled")
        .withColumn("total", _total())
        .filter(F.col("total") >= min_mentions)
        .withColumns({
            "pos_ratio": F.try_divide("positive", "total"),
            "neg_ratio": F.try_divide("negative", "total"),
        })
        .withColumn("signal", F.col("pos_ratio") - F.col("neg_ratio"))
    )


def by_primary_ticker(df: DataFrame) -> DataFrame:
    """One ticker per post, unmapped posts left out."""
    column = "primary_ticker" if "primary_ticker" in df.columns else "query_ticker"
    return (
        df.filter(F.coalesce(F.col(column), F.lit(UNMAPPED)) != UNMAPPED)
        .groupBy(F.col(column).alias("ticker"))
        .agg(*_counts(), F.count("sentiment").alias("_labelled"))
        .filter(F.col("_labelled") > 0).drop("_labelled")
        .withColumn("total", _total())
        .withColumns({"pos_ratio": _ratio("positive"), "neg_ratio": _ratio("negative"),
                      "neu_ratio": _ratio("neutral")})
    )


_STEPS = {"D": ("day", "INTERVAL 1 DAY"), "H": ("hour", "INTERVAL 1 HOUR")}


def sentiment_trend(df: DataFrame, freq: str = "D") -> DataFrame:
    """Mentions per sentiment and bucket, zero-filled between each sentiment's own
    first and last bucket.

    Every bucket is stretched up to the next one of its sentiment, so the filling
    needs no calendar and no second pass.
    """
    unit, step = _STEPS[freq]
    buckets = (
        df.filter(F.col("created_at").isNotNull() & F.col("sentiment").isNotNull())
        .groupBy("sentiment", F.date_trunc(unit, F.col("created_at")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    following = F.lead("bucket").over(Window.partitionBy("sentiment").orderBy("bucket"))
    return (
        buckets.withColumn("_end", F.coalesce(following - F.expr(step), F.col("bucket")))
        .withColumn("created_at", F.explode(F.sequence("bucket", "_end", F.expr(step))))
        .select(
            "sentiment", "created_at",
            F.when(F.col("created_at") == F.col("bucket"), F.col("mentions"))
            .otherwise(F.lit(0)).cast("long").alias("mentions"),
        )
    )


def daily_trend(df: DataFrame) -> DataFrame:
    """Mentions per day and sentiment without filling; null sentiment is a group."""
    return (
        df.filter(F.col("created_at").isNotNull())
        .groupBy(day_of(F.col("created_at")).alias("created_at"), "sentiment")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def topic_risk(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("topic").isNotNull())
        .groupBy("topic").agg(F.count("doc_id").alias("total"), count_label("negative").alias("negative"))
        .withColumn("negative_ratio", F.col("negative") / F.greatest("total", F.lit(1)))
    )


def positive_topics(df: DataFrame, k: int | None = 10) -> DataFrame:
    table = (
        df.groupBy("topic").agg(*_counts(), F.count("sentiment").alias("_labelled"))
        .filter(F.col("topic").isNotNull() & (F.col("_labelled") > 0)).drop("_labelled")
        .withColumn("total", _total())
        .withColumn("positive_ratio", _ratio("positive"))
    )
    if k is None:
        return table
    return top_k(table, k, [F.col("positive_ratio").desc(), F.col("total").desc(), F.col("topic").asc()])


def topic_days(df: DataFrame, label: str) -> DataFrame:
    """Mentions of one sentiment per day and topic."""
    return (
        df.filter((F.col("sentiment") == label) & F.col("created_at").isNotNull())
        .groupBy(day_of(F.col("created_at")).alias("created_at"), "topic")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def _share(label: str) -> Column:
    return F.try_divide(count_label(label), F.count(F.lit(1)))


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(F.col("primary_ticker") != UNMAPPED).alias("mapped_posts"),
        _share("positive").alias("positive_ratio"),
        _share("negative").alias("negative_ratio"),
    )


def live_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct("primary_ticker").alias("tickers"),
        _share("positive").alias("positive_ratio"),
        _share("neutral").alias("neutral_ratio"),
        _share("negative").alias("negative_ratio"),
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("sentiment").isNotNull()).groupBy("sentiment")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def top_tickers(df: DataFrame, k: int = 15) -> DataFrame:
    counted = (
        df.filter(F.col("primary_ticker") != UNMAPPED)
        .groupBy(F.col("primary_ticker").alias("ticker")).agg(F.count(F.lit(1)).alias("mentions"))
    )
    return top_k(counted, k, [F.col("mentions").desc(), F.col("ticker").asc()])


RANKING_METRICS = ("neg_ratio", "pos_ratio", "signal", "total")


def ticker_ranking(df: DataFrame, metric: str, k: int = 20, min_mentions: int = 1) -> DataFrame:
    if metric not in RANKING_METRICS:
        raise ValueError(f"metric must be one of {RANKING_METRICS}")
    return top_k(by_mentioned_ticker(df, min_mentions), k, [F.col(metric).desc(), F.col("tickers").asc()])


def ratios_long(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    return df.unpivot([ticker], ["pos_ratio", "neu_ratio", "neg_ratio"], "ratio", "value")


def legacy_pivot(df: DataFrame, min_mentions: int = 20) -> DataFrame:
    """The older ticker table, over the older ticker lists."""
    return by_mentioned_ticker(df, min_mentions).drop("signal")


def mention_counts(df: DataFrame, k: int) -> DataFrame:
    counted = (
        df.select(F.explode("tickers").alias("ticker")).groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    return top_k(counted, k, [F.col("mentions").desc(), F.col("ticker").asc()])


def retrieved_ratios(df: DataFrame, retrieved: DataFrame, on: str) -> DataFrame:
    """Sentiment of all rows whose text was retrieved (top-k rows, so a small side)."""
    hit = df.join(retrieved.select(on).distinct(), on, "left_semi")
    return (
        hit.agg(*_counts()).withColumn("total", F.greatest(_total(), F.lit(1)))
        .withColumns({"pos_ratio": _ratio("positive"), "neu_ratio": _ratio("neutral"),
                      "neg_ratio": _ratio("negative")})
    )


def summary_facts(df: DataFrame, order: Sequence[Column], by: str, cut: int = 220, examples: int = 3) -> DataFrame:
    """Facts of an extractive summary per question: dominant sentiment (ties by name),
    counts, first ticker and first texts in the given order.

    The rows are read three times, so they are written once, with texts as far as they are shown:
    give a frame of the columns that this and ``order`` need."""
    df = materialize(df.withColumn("text", F.substring("text", 1, cut)), "summary-rows")
    counts = df.groupBy(by, "sentiment").agg(F.count(F.lit(1)).alias("n"))
    tone = counts.groupBy(by).agg(
        F.sum("n").alias("posts"),
        F.sum(F.when(F.col("sentiment") == "positive", F.col("n")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("sentiment") == "neutral", F.col("n")).otherwise(0)).alias("neutral"),
        F.sum(F.when(F.col("sentiment") == "negative", F.col("n")).otherwise(0)).alias("negative"),
        F.min_by("sentiment", F.struct(-F.col("n"), F.col("sentiment"))).alias("dominant"),
    )
    ticker = top_k(df.filter(F.col("primary_ticker").isNotNull()), 1, order, [by]).select(
        by, F.col("primary_ticker").alias("ticker")
    )
    numbered = df.filter(F.col("text").isNotNull()).withColumn(
        "_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ).filter(F.col("_n") <= examples)
    texts = numbered.groupBy(by).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_n", F.col("text").alias("t")))),
                lambda x: F.concat(F.lit("- "), x["t"]),
            ),
            "\n",
        ).alias("evidence")
    )
    return tone.join(ticker, by, "left").join(texts, by, "left")


def topic_shift(before: DataFrame, after: DataFrame, k_before: int = 10, k_after: int = 15) -> DataFrame:
    """Most frequent topics before or after a reprocess with both counts, nulls counted."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy("topic").agg(F.count(F.lit(1)).alias(name))
        order = Window.orderBy(F.col(name).desc(), F.col("topic").asc_nulls_last())  # over topics, not rows
        return counts.withColumn(f"_{name}", F.row_number().over(order))

    left, right = counted(before, "before").alias("b"), counted(after, "after").alias("a")
    same = F.col("b.topic").eqNullSafe(F.col("a.topic"))
    both = left.join(right, same, "full").where((F.col("_before") <= k_before) | (F.col("_after") <= k_after))
    return both.select(F.coalesce("b.topic", "a.topic").alias("topic"), "before", "after")
