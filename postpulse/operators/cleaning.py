"""Cleaning, defaults, ids, deduplication, unions and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postpulse.functions.text import clean_text, contains_any, text_or_empty
from postpulse.operators.joins import keep_first, keep_last

# Tried in turn after the ISO forms that a cast understands.
TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    "MMM dd HH:mm:ss Z yyyy",
)


def add_clean_text(df: DataFrame) -> DataFrame:
    """Text as a string, and its cleaned form."""
    if "text" not in df.columns:
        raise ValueError("input needs a 'text' column")
    return df.withColumn("text", text_or_empty(F.col("text"))).withColumn(
        "clean_text", clean_text(F.col("text"))
    )


def with_clean_text(df: DataFrame) -> DataFrame:
    """Cleaned posts without those whose clean text is empty."""
    return add_clean_text(df).filter(F.length("clean_text") > 0)


def parse_timestamp(column: Column) -> Column:
    """Each value parsed on its own; what cannot be parsed is null."""
    text = F.regexp_replace(column.cast("string"), "^[A-Za-z]{3} (?=[A-Za-z])", "")  # weekday
    return F.coalesce(
        column.try_cast("timestamp"),
        *[F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS],
    )


def timestamp_column(df: DataFrame, name: str) -> Column:
    """A column of the frame as a timestamp, parsed only where it is text."""
    if df.schema[name].dataType == T.TimestampType():
        return F.col(name)
    return parse_timestamp(F.col(name))


def with_created_at(df: DataFrame, run_ts: Column | str) -> DataFrame:
    """``created_at`` as a timestamp; missing and unparseable values take the run time,
    which is an argument so that a rerun gives the same rows."""
    fallback = (F.lit(run_ts) if isinstance(run_ts, str) else run_ts).cast("timestamp")
    if "created_at" not in df.columns:
        return df.withColumn("created_at", fallback)
    return df.withColumn("created_at", F.coalesce(timestamp_column(df, "created_at"), fallback))


def content_hash(columns: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


_NUMBER_SALTS = 64


def with_surrogate_ids(df: DataFrame, name: str, columns: Sequence[str], prefix: str | Column = "local-") -> DataFrame:
    """``name``: a content hash, and from the second of equal rows on their number, so that
    every row has an id of its own and the set of ids is the same wherever it is computed.

    Equal rows are numbered in two levels, within a salt (of the input partition) and over the
    salts, so a text repeated very often is not one task.
    """
    keyed = df.withColumns({
        "_hash": content_hash(columns), "_part": F.pmod(F.spark_partition_id(), F.lit(_NUMBER_SALTS)),
    })
    over = Window.partitionBy("_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("_hash", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_hash", "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_hash", "_part").orderBy(F.lit(0)))
    number = F.col("_before") + within
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    suffix = F.when(F.col("_number") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("_number")))
    return (
        keyed.join(before, ["_hash", "_part"]).withColumn("_number", number)
        .withColumn(name, F.concat(start, F.col("_hash"), suffix))
        .drop("_hash", "_part", "_before", "_number")
    )


def with_defaults(df: DataFrame, run_ts: Column | str) -> DataFrame:
    """Ids, time, author and source for frames that lack them."""
    if "tweet_id" not in df.columns:
        df = with_surrogate_ids(df, "tweet_id", df.columns)
    if "author" not in df.columns:
        df = df.withColumn("author", F.lit("unknown"))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit("manual_or_sample"))
    return with_created_at(df, run_ts)


def repair_ids(df: DataFrame, run_id: Column | None = None) -> DataFrame:
    """``tweet_id`` from ``tweet_id``, else ``id``, else ``doc_id``, else a numbered hash below the run."""
    known = [F.col(c).cast("string") for c in ("tweet_id", "id", "doc_id") if c in df.columns]
    run = run_id if run_id is not None else (
        F.col("run_id") if "run_id" in df.columns else F.lit("run")
    )
    named = df.withColumn("_known", F.coalesce(*known) if known else F.lit(None).cast("string"))
    have = named.where(F.col("_known").isNotNull()).withColumn("tweet_id", F.col("_known")).drop("_known")
    lack = with_surrogate_ids(
        named.where(F.col("_known").isNull()).drop("_known"), "tweet_id", df.columns, F.concat(run, F.lit("_"))
    )
    return have.unionByName(lack)


def _identity(columns: Sequence[str], candidates: Sequence[str]) -> list[str]:
    for name in candidates:
        if name in columns:
            return [name]
    raise ValueError(f"none of {tuple(candidates)} is a column")


def _stack(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("_side", F.lit(0)).unionByName(
        second.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )


def append_to_base(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Union of a base corpus and new rows; on a shared ``doc_id`` the base row stays."""
    return keep_first(_stack(base, new), ["doc_id"], ["_side", order]).drop("_side")


def combine_corpora(batch: DataFrame, live: DataFrame, order: str) -> DataFrame:
    """Union of batch and live rows; on a shared id (else text) the live, later row stays."""
    both = _stack(batch, live)
    key = _identity(both.columns, ("tweet_id", "doc_id", "text"))
    return keep_last(both, key, ["_side", order]).drop("_side")


def by_ticker(df: DataFrame, ticker: str, column: str = "primary_ticker") -> DataFrame:
    """Rows of one ticker, or all rows for 'all'."""
    return df if ticker.lower() == "all" else df.filter(F.col(column) == ticker)


def by_keywords(df: DataFrame, query: str) -> DataFrame:
    """Every blank-separated term must occur in text, ticker or topic."""
    terms = query.strip().lower().split()
    if not terms:
        return df
    pieces = [
        text_or_empty(F.col(c)) if c in df.columns else F.lit("")
        for c in ("text", "primary_ticker", "topic")
    ]
    searchable = F.lower(F.concat_ws(" ", *pieces))
    for term in dict.fromkeys(terms):
        df = df.filter(contains_any(searchable, [term]))
    return df


def by_language(df: DataFrame, lang: str = "en") -> DataFrame:
    """Rows of a language; a missing language counts as English."""
    return df.filter(F.coalesce(F.col("lang"), F.lit("en")) == lang)


def without_noise(df: DataFrame) -> DataFrame:
    """Rows labelled as not noise; an unlabelled row counts as noise."""
    return df.filter(~F.coalesce(F.col("is_noise"), F.lit(True)))
