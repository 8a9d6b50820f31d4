"""Scheduled ingestion as a stream: landed payloads to bronze lineage, silver, gold and latest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.functions.models import Scorer, Translator
from postpulse.functions.tickers import company_lookup
from postpulse.operators.aggregates import gold_daily
from postpulse.operators.cleaning import repair_ids, without_noise
from postpulse.operators.enrich import process_with_rewrites
from postpulse.operators.latest import LATEST_ROWS, latest
from postpulse.operators.relevance import label_posts, with_author_reliability
from postpulse.session import materialize
from postpulse.sources.lake import conform_silver, write_gold, write_silver
from postpulse.sources.payloads import ANY_PAYLOAD, flatten_captures, with_lineage
from postpulse.sources.staged import current, files_at

LATEST_PATH = "gold/twitter_live/latest"
LINEAGE = ("ingestion_date", "run_id", "run_ticker", "raw_uri")


def landed_posts(spark: SparkSession, landing: str, whole_files: bool = True, **options: str) -> DataFrame:
    """Streaming rows of every capture, single or combined, that lands below ``landing``."""
    reader = spark.readStream.schema(ANY_PAYLOAD).option("multiLine", str(whole_files).lower())
    for key, value in options.items():
        reader = reader.option(key, value)
    payloads = reader.json(landing).withColumn("raw_uri", F.col("_metadata.file_path"))
    ticker = F.col("run_ticker")
    return flatten_captures(
        with_lineage(payloads, F.col("raw_uri")), LINEAGE, query_ticker=ticker,
        query_name=F.coalesce(company_lookup(ticker, "name"), ticker),
    ).withColumn("query", F.coalesce("query", ticker)).drop("response_no")


def relevant_silver(
    rows: DataFrame,
    *,
    run_ts: Column | str,
    translator: Translator | None = None,
    model: str = "lexicon",
    scorer: Scorer | None = None,
    labels: DataFrame | None = None,
    mode: str = "scheduled_catalog",
) -> DataFrame:
    """Flattened posts to silver rows: label, drop noise, enrich, override, conform.

    Used by the stream for each micro-batch and by the batch form alike.
    """
    known = with_author_reliability(repair_ids(rows))
    # Written once: the label rules are large, and a filter on their result would
    # otherwise be pushed below them, which evaluates (and plans) them twice.
    labelled = materialize(label_posts(known, F.col("query_ticker"), labels), "labelled")
    # Runs stay apart however files fall into batches: a post that two runs captured is in
    # both.  Repeats of an id within a run: the earliest post stays, whatever the order of
    # files and tasks.  The labels stay on their row, so nothing has to be joined back.
    relevant = without_noise(labelled).withColumns({
        "_row": F.concat_ws("\u0001", "tweet_id", F.col("created_at").cast("string"), "text"),
        "_id": F.col("tweet_id"), "tweet_id": F.concat_ws("\u0001", "run_id", "tweet_id"),
    })
    merged = process_with_rewrites(
        relevant, translator, order="_row", run_ts=run_ts, model=model, scorer=scorer
    ).withColumns({"tweet_id": F.col("_id"), "doc_id": F.col("_id")}).drop("_row", "_id")
    return conform_silver(
        merged.withColumns({"x_query": F.col("query"), "search_mode": F.lit(mode)}),
        source=F.col("source"), run_id=F.col("run_id"), ingestion_date=F.col("ingestion_date"),
        raw_uri=F.col("raw_uri"),
    )


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots that were written to the end, ascending."""
    folder, files = files_at(spark, f"{root}/{LATEST_PATH}")
    if not files.exists(folder):
        return []
    paths = [s.getPath() for s in files.listStatus(folder)]
    whole = [p for p in paths if p.getName().startswith("version=")
             and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in whole)


#: Entry of a manifest: the last version when the snapshot was rewritten.
REWRITTEN_AFTER = f"{LATEST_PATH}#after"


def last_version(spark: SparkSession, root: str) -> int:
    return max(_versions(spark, root), default=-1)


def latest_folder(spark: SparkSession, root: str) -> str | None:
    """The newest snapshot: the last version, or a rewrite that was committed after it."""
    last, manifest = last_version(spark, root), current(spark, root)
    if LATEST_PATH in manifest and int(manifest[REWRITTEN_AFTER]) >= last:
        return f"{root}/{manifest[LATEST_PATH]}"
    return f"{root}/{LATEST_PATH}/version={last}" if last >= 0 else None


def read_latest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot; no other version is read.  Without one: no rows."""
    newest = latest_folder(spark, root)
    return spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema)


def write_latest(snapshot: DataFrame, root: str) -> str:
    """A snapshot goes to a path of its own, above all stored versions whatever checkpoint the
    stream has, so readers never see a half-written one.  The version before stays for readers
    that have begun; older ones go."""
    spark = snapshot.sparkSession
    stored = _versions(spark, root)
    path = f"{root}/{LATEST_PATH}/version={stored[-1] + 1 if stored else 0}"
    snapshot.write.mode("overwrite").parquet(path)
    for old in stored[:-1]:
        place, files = files_at(spark, f"{root}/{LATEST_PATH}/version={old}")
        files.delete(place, True)
    return path


def lake_writer(
    root: str,
    *,
    run_ts: Column | str,
    latest_rows: int = LATEST_ROWS,
    **enrichment,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` sink.  Replaying a batch rewrites the same runs and upserts the same
    posts into the snapshot, so a restart after a failure leaves no duplicates."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        silver = relevant_silver(batch, run_ts=run_ts, **enrichment)
        silver.persist(StorageLevel.MEMORY_AND_DISK)  # three sinks read it
        try:
            if silver.isEmpty():
                return  # nothing relevant: the landed payload is all there is
            write_silver(silver, root)
            write_gold(gold_daily(silver), root)
            before = read_latest(spark, root, silver.schema)
            write_latest(latest(before, silver, order="tweet_id", n=latest_rows), root)
        finally:
            silver.unpersist()

    return write


def run_live_ingestion(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    *,
    run_ts: Column | str,
    whole_files: bool = True,
    latest_rows: int = LATEST_ROWS,
    source_options: dict[str, str] | None = None,
    **enrichment,
) -> None:
    """Ingest everything that landed since the last run, then stop.  The stream's
    checkpoint remembers which files are done."""
    query = (
        landed_posts(spark, landing, whole_files, **(source_options or {}))
        .writeStream.foreachBatch(
            lake_writer(root, run_ts=run_ts, latest_rows=latest_rows, **enrichment)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
