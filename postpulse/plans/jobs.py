"""End-to-end jobs: batch file, upload, backfill, reprocess, question preview, confirmed ingest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postpulse.functions.models import Scorer, Translator
from postpulse.functions.overrides import apply_overrides
from postpulse.operators.aggregates import gold_daily
from postpulse.operators.cleaning import append_to_base, repair_ids, without_noise
from postpulse.operators.enrich import process_posts, process_with_rewrites, reprocess
from postpulse.operators.joins import keep_first, spread_join, top_k
from postpulse.operators.latest import (
    BACKFILL_ROWS, LATEST_ROWS, backfill_labels, latest, latest_tail, missing_runs,
)
from postpulse.operators.relevance import (
    LABEL_COLUMNS, clamp_results, label_posts, merge_candidates, pool_size, ranking_order, with_author_reliability,
    with_engagement_ranking,
)
from postpulse.operators.saved_search import staged_search
from postpulse.session import materialize, store
from postpulse.sources import lake, payloads
from postpulse.sources.schema import infer_mapping, standardize
from postpulse.sources.staged import exists, rewrite, table_path
from postpulse.sources.tables import read_table, write_table
from postpulse.streaming.live import (
    LATEST_PATH, REWRITTEN_AFTER, last_version, latest_folder, read_latest, write_latest,
)


def run_batch(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    *,
    run_ts: str,
    model: str = "lexicon",
    scorer: Scorer | None = None,
) -> str:
    """A file of unknown layout to a file of processed posts."""
    raw = read_table(spark, input_path)
    canonical = standardize(raw, infer_mapping(raw), source_file=input_path, processed_at=run_ts)
    return write_table(process_posts(canonical, run_ts=run_ts, model=model, scorer=scorer), output_path)


@dataclass(frozen=True)
class Upload:
    processed: DataFrame
    paths: dict[str, str | None]
    corpus: DataFrame | None


def ingest_upload(
    spark: SparkSession,
    input_path: str,
    root: str,
    *,
    run_id: str,
    run_ts: str,
    base: DataFrame | None = None,
    model: str = "lexicon",
    scorer: Scorer | None = None,
) -> Upload:
    """An uploaded file into the lake as ``manual_upload``; with ``base`` also the merged corpus."""
    raw = read_table(spark, input_path)
    canonical = standardize(raw, infer_mapping(raw), source_file=input_path, processed_at=run_ts)
    tagged = apply_overrides(process_posts(canonical, run_ts=run_ts, model=model, scorer=scorer)).withColumns({
        "raw_location": F.lit(input_path), "loaded_at": F.lit(run_ts),
    })
    folder = f"{root}/processed/tweets/{run_id}.parquet"
    write_table(tagged, folder)
    processed = spark.read.parquet(folder)
    paths = lake.write_lake(
        processed, root, source="manual_upload", run_id=run_id, ingestion_date=run_ts[:10],
        raw_uri=input_path,
    )
    corpus = None if base is None else append_to_base(base, processed, "tweet_id")
    return Upload(processed, {"processed": folder, **paths}, corpus)


def backfill(
    bronze: DataFrame,
    silver_runs: DataFrame,
    root: str,
    *,
    since: str,
    until: str,
    run_ts: Column | str,
    force: bool = False,
    latest_rows: int | None = None,
) -> DataFrame:
    """Silver and gold for bronze runs that have none yet, and with ``latest_rows`` the snapshot.
    Bronze rows carry ``run_id``, ``run_ticker``, ``ingestion_date`` and the flattened post columns."""
    spark = bronze.sparkSession
    silver = backfilled_silver(bronze, silver_runs, since=since, until=until, run_ts=run_ts, force=force)
    if latest_rows:  # read by two sinks, and computed before silver has the runs
        silver = materialize(silver, "backfilled")
    lake.write_silver(silver, root)
    written = lake.read_silver(spark, root).filter(
        F.col("ingestion_date").between(since, until)
    )
    # Gold of the whole date range is recomputed from silver, run by run.
    lake.write_gold(gold_daily(written), root)
    if latest_rows:
        stored = read_latest(spark, root, silver.schema)
        # of a post in several runs the last run's row stays
        write_latest(latest_tail(stored, silver.withColumn("_at", F.concat_ws("\u0001", "run_id", "tweet_id")), order="_at",
                                 n=latest_rows).drop("_at"), root)
    return written


BRONZE_PATH = "bronze/twitter_live"


def backfill_captures(
    spark: SparkSession,
    root: str,
    *,
    since: str,
    until: str,
    run_ts: Column | str,
    force: bool = False,
    dry_run: bool = False,
    latest_rows: int = BACKFILL_ROWS,
    whole_files: bool = True,
) -> DataFrame:
    """The lake's own captures, single and combined, of runs that have no silver yet, to silver,
    gold and the newest ``latest_rows`` posts.  Returns silver of the date range; a dry run only
    returns the posts per run it would take: ``(ingestion_date, run_id, posts)``."""
    captures = payloads.read_captures(spark, f"{root}/{BRONZE_PATH}", whole_files)
    keep = ("ingestion_date", "run_id", "run_ticker", "raw_uri")
    bronze = payloads.flatten_captures(captures, keep)
    has_silver = exists(spark, table_path(spark, root, lake.SILVER_PATH))
    done = lake.read_silver(spark, root).filter(F.col("source") == payloads.LIVE_SOURCE).select("run_id") if has_silver else \
        bronze.select("run_id").limit(0)
    todo = missing_runs(bronze, done, since=since, until=until, force=force)
    if dry_run:
        return todo.groupBy("ingestion_date", "run_id").agg(F.count(F.lit(1)).alias("posts"))
    # Written once: the rules above plain columns plan quickly, and silver must not change under its own input.
    rows = materialize(todo, "backfill-rows")
    return backfill(rows, done, root, since=since, until=until, run_ts=run_ts, force=True, latest_rows=latest_rows)


def backfilled_silver(
    bronze: DataFrame, silver_runs: DataFrame, *, since: str, until: str, run_ts: Column | str,
    force: bool = False,
) -> DataFrame:
    rows = backfill_labels(repair_ids(missing_runs(bronze, silver_runs, since=since, until=until, force=force)))
    # Runs are processed together but stay apart: a post captured by two runs is in both.
    keyed = rows.withColumn("_id", F.col("tweet_id")).withColumn(
        "tweet_id", F.concat_ws("\u0001", "run_id", "tweet_id")
    )
    processed = process_posts(keyed, run_ts=run_ts).withColumn("tweet_id", F.col("_id"))
    return lake.conform_silver(
        processed.drop("_id").withColumn("query_ticker", F.col("run_ticker")),
        source="twitter_live", run_id=F.col("run_id"), ingestion_date=F.col("ingestion_date"),
        raw_uri=F.col("raw_uri") if "raw_uri" in bronze.columns else None,
    )


def reprocess_table(
    spark: SparkSession, path: str, target: str, *, stamp: str, dry_run: bool = False
) -> DataFrame:
    """Recompute topics and overrides of a stored table into ``target``; a path that is
    being read is never overwritten.  A dry run only returns the new rows."""
    if target.rstrip("/") == path.rstrip("/"):
        raise ValueError("write to a new path, then point readers to it")
    out = reprocess(spark.read.parquet(path), stamp)
    if dry_run:
        return out
    out.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


PROCESSED_PATH = "processed/tweets/latest.parquet"


def reprocess_lake(
    spark: SparkSession, root: str, *, stamp: str, dry_run: bool = False, run: str | None = None
) -> dict[str, DataFrame]:
    """Topics and overrides of everything stored, recomputed: the processed file, the newest posts
    and live silver.  All new tables are staged and committed together; other sources' silver goes
    along unchanged.  Returns each table's rows under its path; a dry run writes nothing."""
    stamped = T.StructType([T.StructField("reprocessed_at", T.StringType())])
    tables: dict[str, tuple[DataFrame, Callable[[DataFrame, str], object]]] = {}

    processed = table_path(spark, root, PROCESSED_PATH)
    if exists(spark, processed):
        tables[PROCESSED_PATH] = reprocess(spark.read.parquet(processed), stamp), store
    newest = latest_folder(spark, root)
    if newest:
        tables[LATEST_PATH] = reprocess(spark.read.parquet(newest), stamp), store
    if exists(spark, table_path(spark, root, lake.SILVER_PATH)):
        silver = lake.read_silver(spark, root, stamped)
        live = F.col("source") == payloads.LIVE_SOURCE
        rows = reprocess(silver.filter(live), stamp).unionByName(silver.filter(~live))
        tables[lake.SILVER_PATH] = rows, lake.write_runs
    if dry_run:
        return {table: rows for table, (rows, _) in tables.items()}
    notes = {REWRITTEN_AFTER: str(last_version(spark, root))} if newest else {}
    moved = rewrite(spark, root, tables, run=run, notes=notes)
    return {
        table: lake.read_silver(spark, root, stamped) if table == lake.SILVER_PATH else spark.read.parquet(f"{root}/{folder}")
        for table, folder in moved.items()
    }


@dataclass(frozen=True)
class Preview:
    """``raw``: ranked and labelled candidates; ``relevant``: processed posts per question."""

    raw: DataFrame
    relevant: DataFrame


def preview(
    posts: DataFrame,
    questions: DataFrame,
    *,
    requested: int = 10,
    run_ts: Column | str,
    scope: str = "broad_all_x",
    language: str = "auto",
    translator: Translator | None = None,
    labels: DataFrame | None = None,
    order: str = "ord",
    label_order: str = "label_pos",
) -> Preview:
    """Answer a table of questions from the posts: search, merge, rank, label, drop noise,
    enrich; labels stay on their row.  After the search every question holds at most a
    candidate pool of posts.  These pairs are written without texts, and the posts found once
    each, because several steps read them.

    ``labels`` are keyed by ``question_id`` (one labeller call each) and ``tweet_id``; of equal
    keys the largest ``label_order`` wins, and a question without labels gets the heuristic.
    """
    pool = pool_size(clamp_results(requested))
    passes = materialize(
        staged_search(posts, questions, max_results=pool, scope=scope, language=language), "preview-passes"
    )
    # Texts stay with their posts, written once each; what is merged, ranked and stored for each
    # question and post is ids, scores and labels.
    ids = passes.select("tweet_id").distinct()
    found = materialize(
        with_engagement_ranking(with_author_reliability(
            keep_first(posts, ["tweet_id"], [order]).join(ids, "tweet_id", "left_semi")
        )),
        "preview-posts",
    )
    narrow = found.select(*[c for c in dict.fromkeys((
        "tweet_id", order, "author_username", "ranking_score", "like_count", "retweet_count", "reply_count", "quote_count",
    )) if c in found.columns])
    candidates = merge_candidates(
        spread_join(passes, narrow, ["tweet_id"], spread_by=["question_id"]), pool,
        order=["pass_no", order], by=["question_id"],
    )
    top = top_k(candidates, pool, ranking_order(), ["question_id"]).select("question_id", "tweet_id", "pass_no")
    asked = questions.select("question_id", F.col("question").alias("live_search_query"))
    told = label_posts(
        top.join(asked, "question_id").join(
            found.select("tweet_id", "text", "author_reliability_tier", "is_curated_market_author"), "tweet_id"
        ), F.col("live_search_query"), labels, label_order, "question_id",
    )
    pairs = materialize(
        told.select("question_id", "tweet_id", "pass_no", "live_search_query", *LABEL_COLUMNS), "preview"
    )
    scores = [c for c in found.columns if c not in posts.columns]
    raw = pairs.join(found, "tweet_id").select(
        "question_id", "tweet_id", *[c for c in posts.columns if c != "tweet_id"], "pass_no", *scores,
        "live_search_query", *LABEL_COLUMNS,
    )

    # A post is processed once, however many questions it is relevant for.
    row = F.concat_ws("\u0001", F.col("question_id").cast("string"), "tweet_id")
    relevant = keep_first(without_noise(pairs).withColumn("_row", row), ["_row"], ["live_search_query"])
    wanted = found.join(relevant.select("tweet_id").distinct(), "tweet_id", "left_semi")
    processed = process_with_rewrites(wanted, translator, order="tweet_id", run_ts=run_ts)
    out = relevant.join(processed, "tweet_id").withColumn("doc_id", F.col("_row")).select(
        *raw.columns, *[c for c in processed.columns if c not in raw.columns]
    ).withColumn("search_mode", F.lit(f"questions_{scope}_preview_then_confirm"))
    return Preview(raw, out)


def confirm_preview(
    result: Preview, bronze: DataFrame | None, root: str, *, run_id: str, ingestion_date: str, latest_rows: int = LATEST_ROWS
) -> dict[str, str | None]:
    """Store a previewed set: the raw capture with all its columns always; silver, gold and the
    newest posts only if there are relevant rows.  Columns of the capture that its own run and
    date would hide are kept as ``post_run_id`` and ``post_ingestion_date``."""
    bronze_path = None
    if bronze is not None:
        bronze_path = f"{root}/{BRONZE_PATH}"
        own = {c: f"post_{c}" for c in ("run_id", "ingestion_date") if c in bronze.columns}
        bronze.withColumnsRenamed(own).withColumns(
            {"ingestion_date": F.lit(ingestion_date), "run_id": F.lit(run_id)}
        ).write.mode("append").partitionBy("ingestion_date", "run_id").json(bronze_path)
    if result.relevant.isEmpty():
        return {"bronze": bronze_path, "silver": None, "gold": None, "latest": None}
    paths = lake.write_lake(
        result.relevant, root, source="twitter_live", run_id=run_id, ingestion_date=ingestion_date,
        raw_uri=bronze_path,
    )
    spark = result.relevant.sparkSession
    silver = lake.read_silver(spark, root).filter(
        (F.col("source") == "twitter_live") & (F.col("ingestion_date") == ingestion_date) & (F.col("run_id") == run_id)
    )
    before = read_latest(spark, root, silver.schema)
    newest = write_latest(latest(before, silver, order="tweet_id", n=latest_rows), root)
    return {"bronze": bronze_path, **paths, "latest": newest}
