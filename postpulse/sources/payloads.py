"""Raw API captures: their schema, flattening, landing and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = """
data array<struct<
  id string, text string, created_at string, author_id string, lang string, source string,
  possibly_sensitive boolean,
  public_metrics struct<retweet_count bigint, reply_count bigint, like_count bigint, quote_count bigint>
>>,
includes struct<users array<struct<
  id string, name string, username string, description string, verified boolean,
  public_metrics struct<followers_count bigint>
>>>
""".replace("\n", " ")
COMBINED_PAYLOAD = (
    f"user_query string, queries array<string>, responses array<struct<{PAYLOAD}>>, strategy string"
)
LIVE_SOURCE = "twitter_live"
#: Captures of both kinds: a single payload has ``data``, a combined one ``responses``.
ANY_PAYLOAD = f"{PAYLOAD}, {COMBINED_PAYLOAD}"


def read_payloads(
    spark: SparkSession, path: str, *, combined: bool = False, whole_files: bool = True
) -> DataFrame:
    """Captured payloads with the lineage their path tells.

    ``whole_files``: one JSON document per file (what an API client lands); otherwise
    one document per line (what ``capture_payloads`` writes, and what splits).
    """
    schema = COMBINED_PAYLOAD if combined else PAYLOAD
    raw = spark.read.schema(schema).option("multiLine", str(whole_files).lower()).json(path)
    return with_lineage(raw.withColumn("raw_uri", F.col("_metadata.file_path")), F.col("raw_uri"))


def flatten_payload(
    payloads: DataFrame,
    *,
    query: Column | None = None,
    query_ticker: Column | None = None,
    query_name: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per post; the author is looked up in the same payload (last entry wins,
    a missing author gives nulls), so no join is needed."""
    nothing = F.lit(None).cast("string")
    query = nothing if query is None else query
    query_ticker = nothing if query_ticker is None else query_ticker
    query_name = nothing if query_name is None else query_name
    rows = payloads.select(
        *keep,
        query.alias("query"), query_ticker.alias("query_ticker"), query_name.alias("query_name"),
        F.col("includes.users").alias("_users"), F.explode("data").alias("_p"),
    )
    author = F.try_element_at(
        F.filter("_users", lambda u: (u["id"] == F.col("_p.author_id")) & (u["id"] != "")), F.lit(-1)
    )
    rows = rows.withColumn("_a", author)
    metric = {m: F.col(f"_p.public_metrics.{m}").alias(m)
              for m in ("retweet_count", "reply_count", "like_count", "quote_count")}
    return rows.select(
        *keep,
        F.col("_p.id").alias("tweet_id"),
        F.coalesce(F.col("_p.text"), F.lit("")).alias("text"),
        F.col("_p.created_at").alias("created_at"),
        F.col("_p.author_id").alias("author_id"),
        F.col("_a.username").alias("author_username"),
        F.col("_a.name").alias("author_name"),
        F.col("_a.verified").alias("author_verified"),
        F.col("_a.description").alias("author_description"),
        F.col("_a.public_metrics.followers_count").alias("author_followers"),
        F.col("_p.lang").alias("lang"),
        F.col("_p.source").alias("tweet_source"),
        F.col("_p.possibly_sensitive").alias("possibly_sensitive"),
        *metric.values(),
        "query", "query_ticker", "query_name",
        F.lit(LIVE_SOURCE).alias("source"),
    )


def flatten_combined(payloads: DataFrame, keep: tuple[str, ...] = (), **constants: Column) -> DataFrame:
    """Every response with its query; a response or query without partner is dropped."""
    pairs = payloads.select(
        *keep, F.posexplode(F.arrays_zip("responses", "queries")).alias("response_no", "_z")
    ).filter(
        F.col("_z.responses").isNotNull() & F.col("_z.queries").isNotNull()
    ).select(*keep, "response_no", F.col("_z.queries").alias("_query"), "_z.responses.*")
    return flatten_payload(pairs, query=F.col("_query"), keep=(*keep, "response_no"), **constants)


def read_captures(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Captures of both kinds below ``path`` with their lineage; a file that is no JSON is one
    row without posts."""
    raw = spark.read.schema(ANY_PAYLOAD).option("multiLine", str(whole_files).lower()).json(path)
    return with_lineage(raw.withColumn("raw_uri", F.col("_metadata.file_path")), F.col("raw_uri"))


def flatten_captures(captures: DataFrame, keep: tuple[str, ...] = (), **constants: Column) -> DataFrame:
    """Posts of single and of combined captures in one pass; ``query`` is null for single ones.
    A response or query without partner is dropped."""
    no_query = F.lit(None).cast("string").alias("query")
    pairs = F.transform(F.arrays_zip("responses", "queries"), lambda z: F.struct(
        z["responses"]["data"].alias("data"), z["responses"]["includes"].alias("includes"), z["queries"].alias("query"),
    ))
    answered = F.filter(pairs, lambda p: p["query"].isNotNull())
    single = F.array(F.struct("data", "includes", no_query))
    rows = captures.select(
        *keep, F.posexplode(F.when(F.col("responses").isNotNull(), answered).otherwise(single)).alias("response_no", "_r")
    ).select(*keep, "response_no", F.col("_r.query").alias("_query"), "_r.data", "_r.includes")
    return flatten_payload(rows, query=F.col("_query"), keep=(*keep, "response_no"), **constants)


def capture_payloads(payloads: DataFrame, path: str) -> str:
    """Land raw payloads as JSON below ``ingestion_date=``; those that name their run also
    below ``run_id=``."""
    runs = ["run_id"] if "run_id" in payloads.columns else []
    payloads.write.mode("append").partitionBy("ingestion_date", *runs).json(path)
    return path


def with_lineage(df: DataFrame, uri: Column) -> DataFrame:
    """``ingestion_date`` (an error when the path has none), ``run_id`` (its folder ``run_id=``, else
    the file stem) and ``run_ticker`` from the path of a capture."""
    day = F.regexp_extract(uri, r"ingestion_date=(\d{4}-\d{2}-\d{2})", 1)
    stem = F.regexp_replace(F.element_at(F.split(uri, "/"), -1), r"(.)\.[^.]*$", "$1")
    run = F.coalesce(F.nullif(F.regexp_extract(uri, "/run_id=([^/]+)/", 1), F.lit("")), stem)
    ticker = F.regexp_extract(F.col("run_id"), "^twitter_live_([a-z0-9]+)_", 1)
    return df.withColumns({
        "ingestion_date": F.when(day != "", day).otherwise(
            F.raise_error(F.concat(F.lit("no ingestion_date in "), uri))
        ),
        "run_id": run,
    }).withColumn("run_ticker", F.when(ticker != "", F.upper(ticker)).otherwise("UNMAPPED"))
