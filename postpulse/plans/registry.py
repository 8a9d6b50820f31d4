"""One runnable query per operator, over the given tables.

Every entry is a function of (session, folder of the tables).  Arrays are shown as
joined text so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions import anchors, authors, overrides, questions as Q, sentiment, text, tickers, topics
from postpulse.functions import dictionaries as D
from postpulse.functions.models import CountingScorer, TaggingTranslator
from postpulse.operators import (
    aggregates as A, cleaning as C, enrich as E, lake_queries as H, latest as L, relevance as R,
    retrieval as G, saved_search as S,
)
from postpulse.operators.joins import spread_join
from postpulse.plans import jobs
from postpulse.session import materialize, new_folder, prepare, store
from postpulse.sources import lake, payloads, schema, tables
from postpulse.sources.posts import (
    ROTATION, document_posts, event_posts, posts, questions, table,
)
from postpulse.streaming import daily, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TS = "2024-02-01 00:00:00"
AS_OF = "2024-01-28"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def _joined(column: str | Column, separator: str = ",") -> Column:
    return F.array_join(F.col(column) if isinstance(column, str) else column, separator)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.process_posts(posts(spark, sf_dir), run_ts=RUN_TS, order="ord")


def _asked(df: DataFrame) -> DataFrame:
    return df.withColumn("query_ticker", L.ticker_for_window(F.col("created_at"), ROTATION))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed posts with overrides, author reliability and labels for their window's ticker."""
    rows = R.with_author_reliability(_asked(overrides.apply_overrides(processed(spark, sf_dir))))
    return R.with_heuristic_labels(rows, F.col("query_ticker"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.conform_silver(
        labelled(spark, sf_dir), source=F.col("source"), run_id=F.col("run_id"),
        ingestion_date=F.col("ingestion_date"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gold_daily(silver(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- sources and sinks ----------------------------------------------------

def _by_lang(df: DataFrame) -> DataFrame:
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.col("doc_id").cast("bigint")).alias("ids"),
    )


@query("A1_read_table")
def _(spark, sf):
    return _by_lang(tables.read_table(spark, f"{sf}/documents.parquet"))


@query("A2_write_table")
def _(spark, sf):
    folder = new_folder(spark, "write-table")
    docs = _documents(spark, sf)
    as_csv = tables.write_table(docs, f"{folder}/documents.csv")
    as_parquet = tables.write_table(docs, f"{folder}/documents.parquet")
    both = tables.read_table(spark, as_csv, docs.schema).withColumn("format", F.lit("csv")).unionByName(
        tables.read_table(spark, as_parquet).withColumn("format", F.lit("parquet"))
    )
    return both.groupBy("format", "lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"),
        F.sum("doc_id").alias("ids"),
    )


def _as_payloads(e: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Posts as API answers, one for each group of ``keys``, with the authors they mention."""
    post = F.struct(
        F.col("ord"), F.col("tweet_id").alias("id"), "text",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        "author_id", "lang", F.lit("web").alias("source"),
        (F.pmod("_n", F.lit(13)) == 0).alias("possibly_sensitive"),
        F.struct("retweet_count", "reply_count", "like_count", "quote_count").alias("public_metrics"),
    )
    known = F.pmod(F.col("author_id").cast("bigint"), F.lit(11)) != 0
    user = F.when(known, F.struct(
        F.col("author_id").alias("id"), F.concat(F.lit("User "), "author_id").alias("name"),
        F.col("author_username").alias("username"), F.lit("bio").alias("description"),
        (F.pmod(F.col("author_id").cast("bigint"), F.lit(2)) == 0).alias("verified"),
        F.struct((F.col("author_id").cast("bigint") * 10).alias("followers_count")).alias("public_metrics"),
    ))
    rows = e.withColumn("_n", F.floor(F.col("ord") / 2)).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.array_sort(F.collect_list(post)).alias("data"),
        F.struct(F.collect_list(user).alias("users")).alias("includes"),
        F.min("ingestion_date").alias("first_date"),
    )
    return rows.withColumn("data", F.transform("data", lambda p: p.dropFields("ord")))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-shaped captures: ten events each, with the authors they mention."""
    rows = _as_payloads(event_posts(spark, sf_dir), {"chunk": F.floor(F.col("_n") / 10)})
    return rows.withColumnRenamed("first_date", "ingestion_date")


_FLAT = ("tweet_id", "text", "created_at", "author_id", "author_username", "author_name",
         "author_verified", "author_followers", "lang", "possibly_sensitive", "retweet_count",
         "reply_count", "like_count", "quote_count", "source")


@query("A3_flatten_payload")
def _(spark, sf):
    path = payloads.capture_payloads(payload_rows(spark, sf).drop("chunk"), new_folder(spark, "bronze"))
    return payloads.flatten_payload(
        payloads.read_payloads(spark, path, whole_files=False)
    ).select(*_FLAT)


@query("A4_flatten_combined")
def _(spark, sf):
    single = payload_rows(spark, sf).withColumn("pair", F.floor(F.col("chunk") / 2))
    response = F.struct("chunk", F.struct("data", "includes").alias("r"))
    combined = single.groupBy("pair").agg(  # two payloads per group
        F.transform(F.array_sort(F.collect_list(response)), lambda x: x["r"]).alias("responses"),
        F.min("ingestion_date").alias("ingestion_date"),
    ).withColumns({
        "user_query": F.concat(F.lit("question "), "pair"),
        # every third capture names one query only: its second response has no partner
        "queries": F.when(F.pmod("pair", F.lit(3)) == 0, F.array(F.lit("first")))
        .otherwise(F.array(F.lit("first"), F.lit("second"), F.lit("third"))),
        "strategy": F.lit("two passes"),
    }).drop("pair")
    path = payloads.capture_payloads(combined, new_folder(spark, "combined"))
    flat = payloads.flatten_combined(payloads.read_payloads(spark, path, combined=True, whole_files=False))
    return flat.select("response_no", "query", *_FLAT)


@query("A5_write_lake")
def _(spark, sf):
    root = new_folder(spark, "lake")
    lake.write_lake(
        E.process_posts(document_posts(spark, sf), run_ts=RUN_TS, order="ord"), root,
        source="manual_upload", run_id="run_documents", ingestion_date="2024-02-01",
    )
    return lake.read_gold(spark, root)


@query("A6_partitioned_tables")
def _(spark, sf):
    root = new_folder(spark, "tables")
    rows = silver(spark, sf)
    lake.write_silver(rows, root)
    lake.write_gold(A.gold_daily(lake.read_silver(spark, root)), root)
    lake.register_views(spark, root)
    return spark.sql("""
        SELECT s.source, s.ingestion_date, s.posts, g.total
        FROM (SELECT source, ingestion_date, count(*) AS posts FROM silver_tweets
              WHERE ingestion_date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL) s
        JOIN (SELECT source, ingestion_date, sum(total) AS total
              FROM gold_sentiment_by_ticker_daily
              WHERE ingestion_date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL) g
        USING (source, ingestion_date)""")


@query("A7_capture_payloads")
def _(spark, sf):
    path = payloads.capture_payloads(payload_rows(spark, sf).drop("chunk"), new_folder(spark, "capture"))
    rows = payloads.read_payloads(spark, path, whole_files=False)
    return rows.groupBy("ingestion_date").agg(
        F.count(F.lit(1)).alias("payloads"), F.sum(F.size("data")).alias("posts"),
        F.sum(F.size("includes.users")).alias("users"),
    )


@query("A8_path_lineage")
def _(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("twitter_live_nvda_")).when(
        F.pmod("event_id", F.lit(3)) == 1, F.lit("twitter_live_bbva_")
    ).otherwise(F.lit("twitter_consultas_live_"))
    uri = F.concat(
        F.lit("file:/lake/bronze/twitter_live/ingestion_date="), F.date_format("ts", "yyyy-MM-dd"),
        F.lit("/"), name, F.col("event_id"), F.lit(".json"),
    )
    return payloads.with_lineage(e.select("event_id", uri.alias("uri")), F.col("uri")).drop("uri")


@query("A9_csv_export")
def _(spark, sf):
    view = processed(spark, sf).select("tweet_id", "clean_text", "tickers", "sentiment", "topic")
    path = tables.export_csv(view, new_folder(spark, "export"))
    back = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return back.groupBy("sentiment", "topic").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("clean_text")).alias("chars"),
        F.sum(F.length("tickers")).alias("ticker_chars"),
    )


# ---- schema inference -----------------------------------------------------

@query("B1_name_score")
def _(spark, sf):
    # the score of a name stands beside that of the column's content, from one scan of each table
    scored = [
        schema.column_candidates(table(spark, sf, name), order).select(F.lit(name).alias("source_table"), "column", "name_score")
        for name, order in (("documents", "doc_id"), ("events", "event_id"), ("pages", "page_id"))
    ]
    return scored[0].unionByName(scored[1]).unionByName(scored[2])


@query("B2_content_score")
def _(spark, sf):
    return schema.content_profile(_documents(spark, sf), "doc_id").select("column", "content_score")


@query("B3_candidates")
def _(spark, sf):
    return schema.column_candidates(_documents(spark, sf), "doc_id").select(
        "column", "score", "rank", F.size("samples").alias("samples"),
        F.coalesce(F.get("samples", F.lit(0)), F.lit("")).alias("first_sample"),
    )


@query("B4_decision")
def _(spark, sf):
    return schema.decide(schema.column_candidates(_documents(spark, sf), "doc_id"))


@query("B5_role_columns")
def _(spark, sf):
    df = _asked(event_posts(spark, sf)).withColumnRenamed("query_ticker", "Symbol")
    role = {r: schema.role_column(df.columns, names) for r, names in (
        ("timestamp", D.TIMESTAMP_NAMES), ("ticker", D.TICKER_NAMES), ("label", D.LABEL_NAMES))}
    return df.groupBy(F.col(role["ticker"]).alias("ticker"), F.lit(role["label"]).alias("label")).agg(
        F.count(F.col(role["timestamp"])).alias("dated")
    )


@query("B6_standardize")
def _(spark, sf):
    docs = _documents(spark, sf).withColumnRenamed("lang", "company")
    mapping = schema.SchemaMapping("text", 0.95, "rules", "given", None, None, "company")
    out = schema.standardize(docs, mapping, source_file=f"{sf}/documents.parquet", processed_at=RUN_TS)
    return out.groupBy("source_file", "schema_method", "schema_confidence", "raw_ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")
    )


@query("B7_profile")
def _(spark, sf):
    return schema.profile_table(_documents(spark, sf), "doc_id").select(
        "row_count", "column_count", "column", "dtype", "score", F.size("samples").alias("samples")
    )


@query("B8_text_fallback")
def _(spark, sf):
    renamed = _documents(spark, sf).withColumnRenamed("text", "body")
    return _by_lang(schema.ensure_text_column(renamed))


# ---- cleaning -------------------------------------------------------------

@query("C1_clean_text")
def _(spark, sf):
    return posts(spark, sf).select("ord", text.clean_text(F.col("text")).alias("clean_text"))


@query("C2_drop_empty")
def _(spark, sf):
    return C.with_clean_text(posts(spark, sf)).select("ord", "tweet_id")


@query("C3_clean_text_legacy")
def _(spark, sf):
    return posts(spark, sf).select("ord", text.clean_text_legacy(F.col("text")).alias("clean"))


@query("C4_parse_timestamp")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    shape = F.pmod("event_id", F.lit(6))
    raw = (
        F.when(shape == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(shape == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(shape == 2, F.date_format(ts, "MM/dd/yyyy HH:mm:ss"))
        .when(shape == 3, F.lit("not a date"))
        .when(shape == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    df = table(spark, sf, "events").select("event_id", raw.alias("created_at"))
    return C.with_created_at(df, RUN_TS)


@query("C5_defaults")
def _(spark, sf):
    df = _documents(spark, sf).select("text", "lang")
    return C.with_defaults(df, RUN_TS).select("tweet_id", "author", "source", "created_at")


@query("C6_dedupe_first")
def _(spark, sf):
    return C.keep_first(posts(spark, sf), ["tweet_id"], ["ord"]).select("tweet_id", "ord")


def _two_corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_posts = posts(spark, sf_dir).withColumn("doc_id", F.col("tweet_id"))
    base = all_posts.filter(F.col("source") == "manual_upload")
    new = event_posts(spark, sf_dir).withColumns({
        "doc_id": F.col("tweet_id"), "text": F.upper("text"), "ord": F.col("ord") + F.lit(1_000_000_000),
    })
    return C.keep_first(base, ["doc_id"], ["ord"]), new


@query("C7_append_to_base")
def _(spark, sf):
    base, new = _two_corpora(spark, sf)
    return C.append_to_base(base, new, "ord").select("doc_id", "ord", F.length("text").alias("chars"))


@query("C8_combine_corpora")
def _(spark, sf):
    base, new = _two_corpora(spark, sf)
    return C.combine_corpora(base, new, "ord").select("doc_id", "ord", F.length("text").alias("chars"))


@query("C9_conform_silver")
def _(spark, sf):
    return silver(spark, sf).select(
        "tweet_id", "text", "created_at", "query_ticker", "primary_ticker", "sentiment",
        "sentiment_confidence", "topic", "is_noise", "like_count", "run_id", "source",
        "ingestion_date", "x_query", "author_id",
    )


@query("C10_repair_ids")
def _(spark, sf):
    df = posts(spark, sf).select(
        F.when(F.pmod("ord", F.lit(4)) == 0, F.col("tweet_id")).alias("tweet_id"),
        F.when(F.pmod("ord", F.lit(4)) == 1, F.concat(F.lit("i"), "ord")).alias("id"),
        F.when(F.pmod("ord", F.lit(4)) == 2, F.concat(F.lit("doc"), "ord")).alias("doc_id"),
        "run_id", "text", "lang",
    )
    return C.repair_ids(df).select("run_id", "tweet_id")


@query("C11_surrogate_ids")
def _(spark, sf):
    docs = _documents(spark, sf).select("lang", "text")
    return C.with_surrogate_ids(docs, "tweet_id", ["text", "lang"]).select("lang", "tweet_id")


@query("C12_by_ticker")
def _(spark, sf):
    return C.by_ticker(processed(spark, sf), "TSLA").select("tweet_id", "primary_ticker", "sentiment")


@query("C13_by_keywords")
def _(spark, sf):
    return C.by_keywords(processed(spark, sf), "  TSLA drop ").select("tweet_id", "primary_ticker", "topic")


@query("C14_by_language")
def _(spark, sf):
    return C.by_language(posts(spark, sf)).select("ord", "tweet_id", "lang")


@query("C15_fold")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("C16_without_noise")
def _(spark, sf):
    rows = labelled(spark, sf).withColumn(
        "is_noise", F.when(F.pmod("ord", F.lit(7)) != 0, F.col("is_noise"))
    )
    return C.without_noise(rows).select("tweet_id", "relevance_score")


# ---- enrichment -----------------------------------------------------------

def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_clean_text(posts(spark, sf_dir))


@query("D1_tickers")
def _(spark, sf):
    return _clean(spark, sf).select("ord", _joined(tickers.extract_tickers(F.col("clean_text"))).alias("tickers"))


@query("D2_primary_ticker")
def _(spark, sf):
    return E.with_tickers(_clean(spark, sf)).select("ord", "primary_ticker")


@query("D3_tickers_legacy")
def _(spark, sf):
    clean = text.clean_text_legacy(F.col("text"))
    return posts(spark, sf).select("ord", _joined(tickers.extract_tickers_legacy(clean)).alias("tickers"))


@query("D4_lexicon_sentiment")
def _(spark, sf):
    return E.with_lexicon_sentiment(_clean(spark, sf)).select("ord", *E.SENTIMENT_COLUMNS)


@query("D5_model_sentiment")
def _(spark, sf):
    scored = E.with_model_sentiment(_clean(spark, sf), CountingScorer())
    return scored.select(
        "ord", "sentiment", "sentiment_model",
        *[F.round(c, 9).alias(c) for c in (
            "sentiment_confidence", "positive_prob", "neutral_prob", "negative_prob", "sentiment_score")],
    )


@query("D5_stored_answers")
def _(spark, sf):
    """Scored in two runs over one store of answers: the second asks only what the first has not."""
    store, clean = new_folder(spark, "answers"), _clean(spark, sf)
    E.with_model_sentiment(clean.filter("ord % 3 <> 0"), CountingScorer(), store=store)
    scored = E.with_model_sentiment(clean, CountingScorer(), store=store)
    return scored.select(
        "ord", "sentiment", "sentiment_model",
        *[F.round(c, 9).alias(c) for c in (
            "sentiment_confidence", "positive_prob", "neutral_prob", "negative_prob", "sentiment_score")],
    )


@query("D6_dispatch")
def _(spark, sf):
    by_model = E.with_sentiment(_clean(spark, sf), "finbert", CountingScorer())
    by_words = E.with_sentiment(_clean(spark, sf), "lexicon")
    keep = ("sentiment_model", "sentiment", "positive_prob")
    both = by_model.select(*keep).unionByName(by_words.select(*keep))
    return both.groupBy("sentiment_model", "sentiment").agg(
        F.count(F.lit(1)).alias("rows"), F.count("positive_prob").alias("with_probability")
    )


@query("D7_topics")
def _(spark, sf):
    return E.with_topic(_clean(spark, sf)).select("ord", "topic")


@query("D8_topic_by_label")
def _(spark, sf):
    e = table(spark, sf, "events")
    label = F.when(F.pmod("event_id", F.lit(10)) != 9, F.floor("value").cast("int") - 3)
    guess = F.when(F.pmod("event_id", F.lit(20)) == 9, F.lit("Tech"))
    return e.select("event_id", topics.topic_by_label(label, guess).alias("topic"))


@query("D9_overrides")
def _(spark, sf):
    rows = overrides.apply_overrides(processed(spark, sf).withColumn(
        "sentiment_confidence",
        F.when(F.pmod("ord", F.lit(5)) == 0, F.lit("NaN").cast("double"))
        .when(F.pmod("ord", F.lit(5)) == 1, 0.95).when(F.pmod("ord", F.lit(5)) == 2, 0.5),
    ))
    return rows.select("tweet_id", "topic", "sentiment",
                       F.nanvl("sentiment_confidence", F.lit(-1.0)).alias("sentiment_confidence"))


@query("D10_rewrite_candidates")
def _(spark, sf):
    return posts(spark, sf).select("ord", overrides.rewrite_candidate(F.col("text")).alias("candidate"))


@query("D11_rewrites")
def _(spark, sf):
    out = E.with_rewrites(posts(spark, sf), TaggingTranslator(fail_on="Baa3"), order="ord")
    return out.select("ord", F.length("model_input_text").alias("chars"), "translation_model",
                      "translation_reason")


@query("D12_author_tier")
def _(spark, sf):
    return posts(spark, sf).select("ord", authors.author_tier(F.col("author_username")).alias("tier"))


@query("D13_curated_author")
def _(spark, sf):
    return posts(spark, sf).select("ord", authors.is_curated(F.col("author_username")).alias("curated"))


@query("D14_language_hint")
def _(spark, sf):
    return questions(spark, sf).select("question_id", Q.language_hint(F.col("question")).alias("lang"))


@query("D15_company")
def _(spark, sf):
    asked = questions(spark, sf).select(F.concat(F.lit("q"), "question_id").alias("id"),
                                        F.col("question").alias("t"))
    told = posts(spark, sf).select(F.concat(F.lit("p"), "ord").alias("id"), F.col("text").alias("t"))
    return asked.unionByName(told).select("id", tickers.infer_company(F.col("t")).alias("company"))


@query("D16_macro_question")
def _(spark, sf):
    return questions(spark, sf).select("question_id", Q.is_macro(F.col("question")).alias("macro"))


@query("D17_search_terms")
def _(spark, sf):
    q = F.col("question")
    return questions(spark, sf).select(
        "question_id", _joined(Q.search_terms(q, Q.language_hint(q)), "|").alias("terms")
    )


@query("D18_refine")
def _(spark, sf):
    return questions(spark, sf).select("question_id", Q.refine(F.col("question")).alias("r")).select(
        "question_id", "r.original", "r.refined", "r.reason"
    )


@query("D19_refine_for_corpus")
def _(spark, sf):
    return questions(spark, sf).select("question_id", Q.refine_for_corpus(F.col("question")).alias("r")).select(
        "question_id", "r.refined", "r.reason"
    )


def _reprocessed_lake(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A lake whose topics are out of date: processed file, silver of two sources, newest posts."""
    root = new_folder(spark, "reprocess")
    stale = store(processed(spark, sf_dir).drop("topic").withColumn("topic", F.lit("old")), f"{root}/{jobs.PROCESSED_PATH}")
    kept = lake.conform_silver(stale, source=F.col("source"), run_id=F.col("run_id"), ingestion_date=F.col("ingestion_date"))
    lake.write_silver(kept, root)
    live.write_latest(L.latest(None, kept.filter(F.col("source") == "twitter_live"), order="tweet_id"), root)
    return jobs.reprocess_lake(spark, root, stamp=RUN_TS)


@query("D20_reprocess")
def _(spark, sf):
    done = _reprocessed_lake(spark, sf)[jobs.PROCESSED_PATH]
    return done.select("tweet_id", "topic", "sentiment", "reprocessed_at")


@query("D20_reprocess_silver")
def _(spark, sf):
    done = _reprocessed_lake(spark, sf)
    newest = done[live.LATEST_PATH].withColumn("in_table", F.lit("latest"))
    silver = done[lake.SILVER_PATH].withColumn("in_table", F.lit("silver"))
    both = newest.select("in_table", "source", "topic", "sentiment", "reprocessed_at").unionByName(
        silver.select("in_table", "source", "topic", "sentiment", "reprocessed_at"))
    return both.groupBy("in_table", "source", "topic", "sentiment", "reprocessed_at").agg(F.count(F.lit(1)).alias("posts"))


@query("D21_process_posts")
def _(spark, sf):
    return processed(spark, sf).select(
        "tweet_id", "doc_id", "clean_text", _joined("tickers").alias("tickers"), "primary_ticker",
        "sentiment", "sentiment_score", "positive_hits", "negative_hits", "topic", "created_at",
        "source", "author",
    )


# ---- relevance, ranking, saved searches -----------------------------------

@query("E1_heuristic_labels")
def _(spark, sf):
    rows = R.with_author_reliability(_asked(posts(spark, sf)))
    return R.with_heuristic_labels(rows, F.col("query_ticker")).select("ord", *R.LABEL_COLUMNS)


def _external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External judgements of documents; every fourth one is given twice."""
    base = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("tweet_id"), F.col("doc_id").alias("pos"),
        (F.col("quality") == 0).alias("is_noise"), (F.col("quality") * 0.5 + 0.25).alias("relevance_score"),
        F.concat(F.lit("toxic="), "toxic").alias("noise_reason"),
    )
    again = base.filter(F.pmod("pos", F.lit(4)) == 0).withColumns({
        "pos": F.col("pos") + 1_000_000_000, "is_noise": ~F.col("is_noise"),
        "noise_reason": F.lit("second opinion"),
    })
    return base.unionByName(again)


@query("E2_attach_labels")
def _(spark, sf):
    return R.attach_labels(posts(spark, sf), _external_labels(spark, sf), "pos").select("ord", *R.LABEL_COLUMNS)


def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeller answers in the shapes such answers come in, one per labelled document."""
    one = F.to_json(F.struct(
        F.concat(F.lit("d"), "doc_id").alias("tweet_id"), (F.col("quality") == 0).alias("is_noise"),
        (F.col("quality") * 0.5 + 0.25).alias("relevance_score"),
        F.concat(F.lit("brace } and \" quote "), "toxic").alias("reason"),
    ))
    two = F.to_json(F.struct(F.concat(F.lit("x"), "doc_id").alias("tweet_id")))
    shape = F.pmod("doc_id", F.lit(7))
    response = (
        F.when(shape == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("```json\n["), one, F.lit("]\n```")))
        .when(shape == 2, F.concat(F.lit("Here you go: ["), one, F.lit("] thanks")))
        .when(shape == 3, F.concat(F.lit('{"results": ['), one, F.lit(","), two, F.lit("]}")))
        .when(shape == 4, one)
        .when(shape == 5, F.concat(F.lit("["), one, F.lit(","), two, F.lit(',{"tweet_id": "cut')))
        .otherwise(F.lit("no labels here"))
    )
    return table(spark, sf_dir, "labels").select("doc_id", response.alias("response"))


@query("E3_parse_labels")
def _(spark, sf):
    return R.parse_labels(label_responses(spark, sf))


@query("E3_parse_later_blocks")
def _(spark, sf):
    """The first fenced block is a broken draft without labels, the second has them."""
    one = F.to_json(F.struct(
        F.concat(F.lit("d"), "doc_id").alias("tweet_id"), (F.col("quality") == 0).alias("is_noise"),
        (F.col("quality") * 0.5 + 0.25).alias("relevance_score"), F.concat(F.lit("toxic "), "toxic").alias("reason"),
    ))
    two = F.to_json(F.struct(F.concat(F.lit("x"), "doc_id").alias("tweet_id")))
    response = F.concat(
        F.lit('A draft:\n```\n[{"note": "draft"}\n```\nand the labels:\n```json\n['), one, F.lit(", "), two, F.lit("]\n```\nDone.")
    )
    return R.parse_labels(table(spark, sf, "labels").select("doc_id", response.alias("response")))


@query("E4_label_posts")
def _(spark, sf):
    rows = R.with_author_reliability(_asked(posts(spark, sf)))
    told = R.label_posts(rows, F.col("query_ticker"), _external_labels(spark, sf), "pos")
    guessed = R.label_posts(rows, F.col("query_ticker"))
    both = told.select(F.lit("external").alias("labeller"), *R.LABEL_COLUMNS).unionByName(
        guessed.select(F.lit("heuristic").alias("labeller"), *R.LABEL_COLUMNS))
    return both.groupBy("labeller", *R.LABEL_COLUMNS).agg(F.count(F.lit(1)).alias("rows"))


@query("E5_engagement_ranking")
def _(spark, sf):
    return R.with_engagement_ranking(posts(spark, sf)).select(
        "ord", F.round("engagement_score", 6).alias("engagement_score"),
        F.round("engagement_rank_score", 6).alias("engagement_rank_score"), "source_score",
        "finance_relevance_score", "noise_penalty", "off_topic_penalty",
        F.round("ranking_score", 6).alias("ranking_score"),
    )


@query("E6_top_ranked")
def _(spark, sf):
    rows = C.keep_first(posts(spark, sf), ["tweet_id"], ["ord"]).withColumn("day", A.day_of(F.col("created_at")))
    return R.ranked(rows.filter(F.col("day").isNotNull()), R.pool_size(8), ["day"]).select(
        "day", "tweet_id", F.round("ranking_score", 6).alias("ranking_score")
    )


@query("E7_merge_candidates")
def _(spark, sf):
    rows = _asked(posts(spark, sf)).filter(F.col("query_ticker").isNotNull())
    return R.merge_candidates(rows, 20, order=["ord"], by=["query_ticker"]).select(
        "query_ticker", "tweet_id", "ord", "author_reliability_tier", "is_curated_market_author"
    )


@query("E8_anchor_groups")
def _(spark, sf):
    asked = questions(spark, sf).select(F.concat(F.lit("q"), "question_id").alias("id"),
                                        F.col("question").alias("t"))
    told = posts(spark, sf).select(F.concat(F.lit("p"), "ord").alias("id"), F.col("text").alias("t"))
    groups = anchors.anchor_groups(F.col("t"))
    return asked.unionByName(told).select("id", groups.alias("g")).select(
        "id", _joined(F.transform("g", lambda x: F.concat_ws(":", x["name"], x["kind"]))).alias("groups")
    )


@query("E9_required_anchors")
def _(spark, sf):
    g = anchors.with_implied_context(anchors.anchor_groups(F.col("question")))
    return questions(spark, sf).select("question_id", g.alias("g")).select(
        "question_id", _joined(anchors.names(F.col("g"))).alias("groups"),
        anchors.required_count(F.col("g")).alias("required"),
    )


@query("E10_anchor_filter")
def _(spark, sf):
    # one fixed question, and a question per post (its own author's name and text)
    fixed = R.anchor_filter(posts(spark, sf), "Mexico Moody").select(
        F.lit("fixed").alias("asked"), "ord", "anchor_match_count")
    asked = F.concat_ws(" ", "author_username", "query_ticker", F.lit("Moody"))
    varying = R.anchor_filter(_asked(posts(spark, sf)), asked).select(
        F.lit("own").alias("asked"), "ord", "anchor_match_count")
    return fixed.unionByName(varying)


def _match_table(spark: SparkSession, sf_dir: str, searches: DataFrame) -> DataFrame:
    """Matches per distinct search, with the search's own content as its key."""
    rows = posts(spark, sf_dir)
    counted = S.match_searches(rows, searches, "ord", totals=True)
    names = S.with_search_key(searches).select(
        "search_key", F.array_join(F.transform("clauses", lambda c: F.array_join(c, "|")), "&").alias("clauses"),
        F.coalesce("lang", F.lit("any")).alias("lang"),
    ).dropDuplicates(["search_key"])
    return counted.join(names, "search_key").drop("search_key")


@query("E11_anchored_search")
def _(spark, sf):
    return _match_table(spark, sf, S.precise_searches(questions(spark, sf)))


@query("E12_company_search")
def _(spark, sf):
    asked = _asked(event_posts(spark, sf)).select(F.col("query_ticker").alias("ticker")).filter(
        F.col("ticker").isNotNull()
    ).distinct()
    open_search = S.company_searches(asked, curated=False)
    curated = S.company_searches(asked, language="es", curated=True)
    return _match_table(spark, sf, open_search.unionByName(curated))


@query("E13_broad_search")
def _(spark, sf):
    return _match_table(spark, sf, S.broad_searches(questions(spark, sf)))


@query("E14_staged_search")
def _(spark, sf):
    rows = C.keep_first(posts(spark, sf), ["tweet_id"], ["ord"])
    return S.staged_search(rows, questions(spark, sf), max_results=20)


@query("E15_preview")
def _(spark, sf):
    rows = C.keep_first(posts(spark, sf), ["tweet_id"], ["ord"])
    result = jobs.preview(rows, questions(spark, sf), requested=10, run_ts=RUN_TS)
    return result.relevant.select(
        "question_id", "tweet_id", "sentiment", "topic", "is_noise", "relevance_score", "noise_reason",
        "author_reliability_tier",
    )


def _call_labels(asked: DataFrame) -> DataFrame:
    """Labels of one call for each question, given twice; every third call failed, and a call
    leaves out some posts."""
    given = asked.filter("question_id % 3 <> 0 AND (question_id + length(tweet_id)) % 5 <> 0").select("question_id", "tweet_id")
    first = given.select("*", F.lit(0).alias("label_pos"), F.lit(True).alias("is_noise"), F.lit(0.1).alias("relevance_score"),
                         F.lit("first opinion").alias("noise_reason"))
    again = given.select("*", F.lit(1).alias("label_pos"), F.expr("(question_id + length(tweet_id)) % 2 = 0").alias("is_noise"),
                         F.lit(0.5).alias("relevance_score"), F.expr("concat('call ', question_id)").alias("noise_reason"))
    return again.unionByName(first)


@query("E15_preview_labelled")
def _(spark, sf):
    rows = C.keep_first(posts(spark, sf), ["tweet_id"], ["ord"])
    asked = jobs.preview(rows, questions(spark, sf), requested=10, run_ts=RUN_TS).raw
    result = jobs.preview(rows, questions(spark, sf), requested=10, run_ts=RUN_TS, labels=_call_labels(asked))
    return result.relevant.select(
        "question_id", "tweet_id", "sentiment", "topic", "is_noise", "relevance_score", "noise_reason",
        "author_reliability_tier",
    )


@query("E16_join_back")
def _(spark, sf):
    right = R.with_heuristic_labels(_asked(posts(spark, sf)), F.col("query_ticker"))
    left = processed(spark, sf).withColumn("is_noise", F.lit(None).cast("boolean"))
    return R.join_back(left, right, R.LABEL_COLUMNS, "ord").select("tweet_id", *R.LABEL_COLUMNS)


# ---- aggregates -----------------------------------------------------------

@query("F1_gold_daily")
def _(spark, sf):
    return gold(spark, sf)


@query("F2_gold_by_source")
def _(spark, sf):
    return A.gold_by_source(processed(spark, sf), "2024-02-01")


@query("F3_by_mentioned_ticker")
def _(spark, sf):
    return A.by_mentioned_ticker(processed(spark, sf), 2)


@query("F4_by_primary_ticker")
def _(spark, sf):
    return A.by_primary_ticker(processed(spark, sf))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentiment is only posted on some days, so that the trend has gaps."""
    day = F.dayofmonth("created_at")
    keep = F.when(F.col("sentiment") == "positive", F.pmod(day, F.lit(3)) == 0).when(
        F.col("sentiment") == "negative", day.between(5, 20) & (F.pmod(day, F.lit(4)) != 0)
    ).otherwise(F.lit(True))
    return processed(spark, sf_dir).withColumn("created_at", F.when(keep, F.col("created_at")))


@query("F5_trend_daily")
def _(spark, sf):
    return A.sentiment_trend(_sparse(spark, sf))


@query("F5_trend_hourly")
def _(spark, sf):
    return A.sentiment_trend(_sparse(spark, sf), "H")


@query("F6_daily_trend")
def _(spark, sf):
    return A.daily_trend(_sparse(spark, sf))


@query("F7_topic_risk")
def _(spark, sf):
    return A.topic_risk(processed(spark, sf))


@query("F8_positive_topics")
def _(spark, sf):
    return A.positive_topics(processed(spark, sf))


@query("F9_topic_days")
def _(spark, sf):
    rows = processed(spark, sf)
    return A.topic_days(rows, "negative").withColumn("sentiment", F.lit("negative")).unionByName(
        A.topic_days(rows, "positive").withColumn("sentiment", F.lit("positive"))
    )


@query("F10_overview")
def _(spark, sf):
    return A.overview(processed(spark, sf))


@query("F11_live_overview")
def _(spark, sf):
    return A.live_overview(processed(spark, sf).filter(F.col("source") == "twitter_live"))


@query("F12_distribution")
def _(spark, sf):
    return A.sentiment_distribution(processed(spark, sf))


@query("F13_top_tickers")
def _(spark, sf):
    return A.top_tickers(processed(spark, sf))


@query("F14_ticker_ranking")
def _(spark, sf):
    rows = processed(spark, sf)
    parts = [A.ticker_ranking(rows, m, 5).withColumn("metric", F.lit(m)) for m in A.RANKING_METRICS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("metric", "tickers", "total", "neg_ratio", "pos_ratio", "signal")


@query("F15_ratios_long")
def _(spark, sf):
    return A.ratios_long(A.by_primary_ticker(processed(spark, sf)))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = processed(spark, sf_dir)
    clean = text.clean_text_legacy(F.col("text"))
    return rows.withColumn("tickers", tickers.extract_tickers_legacy(clean))


@query("F16_legacy_pivot")
def _(spark, sf):
    return A.legacy_pivot(_legacy(spark, sf))


@query("F17_mention_counts")
def _(spark, sf):
    return A.mention_counts(_legacy(spark, sf), 20)


@query("F18_retrieved_ratios")
def _(spark, sf):
    rows = processed(spark, sf)
    retrieved = R.ranked(rows, 30).select("clean_text")
    return A.retrieved_ratios(rows, retrieved, "clean_text")


@query("F19_summary_facts")
def _(spark, sf):
    rows = R.with_engagement_ranking(processed(spark, sf)).withColumn("day", A.day_of(F.col("created_at")))
    needed = rows.select("day", "sentiment", "primary_ticker", "text", "ranking_score", "tweet_id")
    return A.summary_facts(needed, R.ranking_order(), "day")


@query("F20_topic_shift")
def _(spark, sf):
    before = processed(spark, sf).withColumn(
        "topic", F.when(F.pmod("ord", F.lit(4)) != 0, F.col("topic"))
    )
    # one pass over the posts, each topic beside the one it had
    after = E.reprocess(before.withColumn("_before", F.col("topic")), RUN_TS)
    both = materialize(after.select("_before", "topic"), "topic-shift")
    return A.topic_shift(both.select(F.col("_before").alias("topic")), both.select("topic"))


# ---- retrieval ------------------------------------------------------------

def _index(spark: SparkSession, sf_dir: str) -> G.TfidfIndex:
    return G.build_index(_documents(spark, sf_dir), column="text")


@query("G1_tfidf_index")
def _(spark, sf):
    index = _index(spark, sf)
    # heaviest postings of every document, and the size of its vector
    return index.postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("top_weight"),
        F.round(F.sum("weight"), 6).alias("weight_sum"),
    )


@query("G1_vocabulary")
def _(spark, sf):
    return _index(spark, sf).vocabulary.select("term", "df", F.round("idf", 9).alias("idf"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the index and the evidence both read it."""
    needed = processed(spark, sf_dir).select("doc_id", "clean_text", "sentiment", "tickers", "topic")
    return materialize(needed, "corpus")


def _hits(spark: SparkSession, sf_dir: str, corpus: DataFrame, k: int = 10) -> DataFrame:
    asked = questions(spark, sf_dir).select(
        "question_id", Q.refine_for_corpus(F.col("question"))["refined"].alias("question")
    )
    # The same refined text is searched once; its hits belong to every question that asked it.
    keyed = asked.withColumn("question_key", F.xxhash64("question"))
    unique = keyed.dropDuplicates(["question_key"]).select(
        F.col("question_key").alias("question_id"), "question")
    hits = G.search_index(G.build_index(corpus), unique, k=k)
    back = keyed.select("question_id", "question_key")
    # One question may be asked by very many: they are the salted side.
    return spread_join(
        back, hits.withColumnRenamed("question_id", "question_key"), ["question_key"], spread_by=["question_id"]
    ).drop("question_key")


@query("G2_search")
def _(spark, sf):
    # nothing else is read of the corpus, so it is not written
    return _hits(spark, sf, processed(spark, sf)).select("question_id", "rank", "score")


@query("G3_answer_facts")
def _(spark, sf):
    corpus = _corpus(spark, sf)
    return G.answer_facts(G.with_evidence(_hits(spark, sf, corpus), corpus))


@query("G4_evidence_payload")
def _(spark, sf):
    corpus = _corpus(spark, sf)
    return G.evidence_payload(G.with_evidence(_hits(spark, sf, corpus), corpus))


@query("G5_vector_search")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # one query per label: the mean of its vectors
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("a"))
        .select(F.col("label").alias("query_id"), F.transform("a", lambda x: x["m"]).alias("query"))
    )
    return G.vector_search(vectors, means, k=30).withColumn("score", F.round("score", 6))


@query("G6_insert_absent")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    existing = vectors.filter(F.col("label") % 2 == 0)
    new = vectors.withColumn("label", F.col("label") + 100)
    merged = G.insert_absent(existing, new, "vec_id", "label")
    return merged.select("vec_id", "label", F.size("embedding").alias("dims"))


# ---- lake queries ---------------------------------------------------------

@query("H1_recent_live")
def _(spark, sf):
    return H.recent_live(silver(spark, sf), AS_OF)


@query("H2_gold_window")
def _(spark, sf):
    return H.gold_window(gold(spark, sf), AS_OF, 14)


@query("H3_manual_uploads")
def _(spark, sf):
    return H.manual_uploads(silver(spark, sf))


@query("H4_live_without_noise")
def _(spark, sf):
    return H.live_without_noise(silver(spark, sf))


@query("H5_gold_listing")
def _(spark, sf):
    return H.gold_listing(gold(spark, sf))


@query("H6_live_versus_batch")
def _(spark, sf):
    return H.live_versus_batch(gold(spark, sf))


# ---- incremental ----------------------------------------------------------

@query("L1_live_ingestion")
def _(spark, sf):
    landing, root = new_folder(spark, "landing"), new_folder(spark, "live")
    payloads.capture_payloads(payload_rows(spark, sf).drop("chunk"), landing)
    live.run_live_ingestion(
        spark, landing, root, new_folder(spark, "progress"), run_ts=RUN_TS, whole_files=False
    )
    return lake.read_silver(spark, root).groupBy("ingestion_date", "primary_ticker", "sentiment", "is_noise").agg(
        F.count(F.lit(1)).alias("posts")
    )


@query("L2_ticker_rotation")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", L.ticker_for_window(F.col("ts").cast("timestamp"), ROTATION).alias("ticker")
    )


def _backfilled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A lake with captures of every run, half of them combined, and silver of every third day."""
    root, rows = new_folder(spark, "backfill"), event_posts(spark, sf_dir)
    captures = _as_payloads(rows, {"run_id": F.col("run_id"), "ingestion_date": F.col("ingestion_date"), "chunk": F.floor(F.col("_n") / 100)})
    combined = F.pmod("chunk", F.lit(2)) == 0
    payloads.capture_payloads(captures.select(
        "run_id", "ingestion_date", F.when(~combined, F.col("data")).alias("data"),
        F.when(~combined, F.col("includes")).alias("includes"),
        F.when(combined, F.lit("asked")).alias("user_query"), F.when(combined, F.array(F.lit("q"))).alias("queries"),
        F.when(combined, F.array(F.struct("data", "includes"))).alias("responses"),
    ), f"{root}/{jobs.BRONZE_PATH}")
    done = rows.filter(F.dayofmonth("ingestion_date") % 3 == 0)
    lake.write_silver(lake.conform_silver(
        done, source="twitter_live", run_id=F.col("run_id"), ingestion_date=F.col("ingestion_date")), root)
    return jobs.backfill_captures(
        spark, root, since="2024-01-05", until="2024-01-25", run_ts=RUN_TS, whole_files=False), root


@query("L3_backfill")
def _(spark, sf):
    out, _ = _backfilled(spark, sf)
    return out.filter("noise_reason is not null").groupBy("run_id", "noise_reason", "sentiment").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("relevance_score").alias("relevance")
    )


@query("L3_backfill_latest")
def _(spark, sf):
    out, root = _backfilled(spark, sf)
    return live.read_latest(spark, root, out.schema).select("tweet_id", "run_id", "noise_reason")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = posts(spark, sf_dir)
    old = rows.filter(F.col("source") == "twitter_live")
    new = rows.withColumns({"ord": F.col("ord") + 1_000_000_000, "text": F.concat("text", F.lit(" (edited)"))})
    return old, new.filter(F.col("like_count").isNotNull())


@query("L4_latest")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return L.latest(old, new, order="ord").select("tweet_id", "ord", "created_at")


@query("L5_latest_tail")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return L.latest_tail(old, new, order="ord").select("tweet_id", "ord", "created_at")


def _confirmed(spark: SparkSession, sf_dir: str) -> str:
    root = new_folder(spark, "confirm")
    rows = C.keep_first(posts(spark, sf_dir), ["tweet_id"], ["ord"])
    result = jobs.preview(rows, questions(spark, sf_dir), requested=5, run_ts=RUN_TS)
    jobs.confirm_preview(result, result.raw, root, run_id="run_confirmed", ingestion_date="2024-02-01")
    return root


@query("L6_confirm_preview")
def _(spark, sf):
    stored = lake.read_silver(spark, _confirmed(spark, sf))
    return stored.groupBy("search_mode", "is_noise", "topic").agg(F.count(F.lit(1)).alias("posts"))


@query("L6_confirm_bronze")
def _(spark, sf):
    raw = spark.read.json(f"{_confirmed(spark, sf)}/{jobs.BRONZE_PATH}")
    return raw.select("question_id", "tweet_id", F.length("text").alias("n_chars"), "like_count", "is_noise",
                      "noise_reason", F.col("post_run_id").alias("captured_by"), "run_id")


@query("L6_confirm_latest")
def _(spark, sf):
    root = _confirmed(spark, sf)
    return live.read_latest(spark, root, lake.SILVER).select("tweet_id", "run_id")


@query("L7_upload")
def _(spark, sf):
    root = new_folder(spark, "upload")
    path = f"{root}/incoming/documents.parquet"
    tables.write_table(_documents(spark, sf).select("text", "n_chars"), path)
    base = processed(spark, sf).filter(F.col("source") == "manual_upload")
    upload = jobs.ingest_upload(spark, path, root, run_id="run_upload", run_ts=RUN_TS, base=base)
    return upload.corpus.groupBy("source", "sentiment", "topic").agg(F.count(F.lit(1)).alias("posts"))


@query("L8_daily_stream")
def _(spark, sf):
    landing, out = new_folder(spark, "silver-stream"), new_folder(spark, "daily")
    rows = silver(spark, sf).select("tweet_id", "created_at", "primary_ticker", "sentiment")
    # a later row closes the last day; its own day stays open
    later = rows.orderBy(F.col("created_at").desc(), "tweet_id").limit(1).withColumns({
        "created_at": F.col("created_at") + F.expr("INTERVAL 100 DAYS"), "tweet_id": F.lit("later"),
    })
    rows.write.mode("append").parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    checkpoint = new_folder(spark, "daily-progress")
    daily.run_daily_counts(stream, out, checkpoint, "60 days")
    later.write.mode("append").parquet(landing)
    daily.run_daily_counts(stream, out, checkpoint, "60 days")
    return spark.read.parquet(out)
