"""Silver and gold tables: declared schemas, conformance, partitioned writes, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.operators.aggregates import gold_daily
from postpulse.operators.cleaning import timestamp_column
from postpulse.session import shuffles_freed
from postpulse.sources.staged import table_path

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(ddl: str) -> T.StructType:
    pairs = (part.split() for part in ddl.replace("\n", " ").split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SILVER = _schema("""
tweet_id string, text string, clean_text string, author_id string, author_username string,
created_at timestamp, query_ticker string, query_name string, primary_ticker string,
sentiment string, sentiment_confidence double, positive_prob double, neutral_prob double,
negative_prob double, sentiment_model string, topic string, is_noise boolean,
relevance_score double, noise_reason string, live_search_query string, x_query string,
search_mode string, like_count bigint, retweet_count bigint, reply_count bigint,
quote_count bigint, run_id string, raw_s3_uri string, source string, ingestion_date string
""")
GOLD = _schema("""
ticker string, created_date string, positive bigint, neutral bigint, negative bigint,
total bigint, pos_ratio double, neg_ratio double, neu_ratio double, run_id string,
source string, ingestion_date string
""")
PARTITIONS = ("source", "ingestion_date")
SOURCES = ("twitter_live", "manual_upload")
SILVER_PATH = "silver/tweets"
GOLD_PATH = "gold/sentiment_by_ticker_daily"
RUN_PARTITIONS = (*PARTITIONS, "run_id")


def _lit(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def conform_silver(
    df: DataFrame,
    *,
    source: Column | str,
    run_id: Column | str,
    ingestion_date: Column | str,
    raw_uri: Column | str | None = None,
) -> DataFrame:
    """Project to the silver schema: missing columns get their default, a bad
    ``created_at`` is null (not the run time), the id falls back to ``doc_id``."""
    given = {
        "source": _lit(source), "run_id": _lit(run_id), "ingestion_date": _lit(ingestion_date),
        "raw_s3_uri": _lit(raw_uri),
    }
    columns = []
    for field in SILVER.fields:
        name = field.name
        if name in given:
            value = given[name]
        elif name == "tweet_id" and name not in df.columns and "doc_id" in df.columns:
            value = F.col("doc_id")
        elif name == "created_at" and name in df.columns:
            value = timestamp_column(df, name)
        elif name in df.columns:
            value = F.col(name)
        elif name in ("text", "clean_text"):
            value = F.lit("")
        elif name == "is_noise":
            value = F.lit(False)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(name))
    return df.select(*columns)


def write_runs(df: DataFrame, path: str) -> None:
    """One folder per (source, ingestion date, run).  Writing a run again replaces that
    run and nothing else; the rebalance gives files of a sensible size and splits a
    run that holds most of the rows."""
    with shuffles_freed(df.sparkSession):
        (
            df.hint("rebalance", *RUN_PARTITIONS)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            .partitionBy(*RUN_PARTITIONS).parquet(path)
        )


def write_silver(silver: DataFrame, root: str) -> str:
    path = table_path(silver.sparkSession, root, SILVER_PATH)
    write_runs(silver, path)
    return path


def write_gold(gold: DataFrame, root: str) -> str:
    path = table_path(gold.sparkSession, root, GOLD_PATH)
    write_runs(gold, path)
    return path


def read_silver(spark: SparkSession, root: str, extra: T.StructType | None = None) -> DataFrame:
    """Silver where it is now; ``extra`` names columns that a rewrite has added."""
    fields = SILVER.fields + (extra.fields if extra else [])
    path = table_path(spark, root, SILVER_PATH)
    return spark.read.schema(T.StructType(fields)).parquet(path).select(*[f.name for f in fields])


def read_gold(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(GOLD).parquet(table_path(spark, root, GOLD_PATH)).select(*GOLD.names)


def write_lake(
    processed: DataFrame,
    root: str,
    *,
    source: str,
    run_id: str,
    ingestion_date: str,
    raw_uri: str | None = None,
) -> dict[str, str | None]:
    """Silver and gold of one run.  Gold is computed from the silver files just written
    (three partition values prune the read), not from the input again, and is
    skipped when it has no rows."""
    spark = processed.sparkSession
    silver_path = write_silver(
        conform_silver(
            processed, source=source, run_id=run_id, ingestion_date=ingestion_date, raw_uri=raw_uri
        ),
        root,
    )
    written = read_silver(spark, root).filter(
        (F.col("source") == source) & (F.col("ingestion_date") == ingestion_date)
        & (F.col("run_id") == run_id)
    )
    gold = gold_daily(written)
    if gold.isEmpty():
        return {"silver": silver_path, "gold": None}
    return {"silver": silver_path, "gold": write_gold(gold, root)}


def register_views(spark: SparkSession, root: str, prefix: str = "") -> None:
    """Temporary views over the partitioned files, restricted to the known sources."""
    for name, df in (
        (f"{prefix}silver_tweets", read_silver(spark, root)),
        (f"{prefix}gold_sentiment_by_ticker_daily", read_gold(spark, root)),
    ):
        df.filter(F.col("source").isin(list(SOURCES))).createOrReplaceTempView(name)


def table_ddl(name: str, schema: T.StructType, location: str) -> str:
    """DDL of an external table over the same files."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return (
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(RUN_PARTITIONS)}) LOCATION '{location}'"
    )
