"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

$BENCH_QUERIES may name other queries (comma-separated prefixes, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from postpulse.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "C1_clean_text", "C6_dedupe_first", "C8_combine_corpora", "C15_fold", "D1_tickers",
    "D4_lexicon_sentiment", "D5_model_sentiment", "D7_topics", "D9_overrides", "D15_company",
    "D21_process_posts", "E1_heuristic_labels", "E2_attach_labels", "E3_parse_labels",
    "E5_engagement_ranking", "E6_top_ranked", "E8_anchor_groups", "E10_anchor_filter",
    "E13_broad_search", "F1_gold_daily", "F3_by_mentioned_ticker", "F5_trend_hourly",
    "F7_topic_risk", "G1_tfidf_index", "G2_search", "G5_vector_search", "H2_gold_window",
    "L1_live_ingestion", "L4_latest",
    "E14_staged_search", "E15_preview", "F19_summary_facts", "G3_answer_facts", "L6_confirm_preview",
    "L7_upload", "L8_daily_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(HEADLINE)
    if wanted == "all":
        names = list(QUERIES)
    elif wanted:
        names = [n for n in QUERIES if any(n.startswith(w) for w in wanted.split(","))]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.postpulse.inputPartitions", "8")  # each table is one row group here
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["A1_read_table"](spark, sf_dir).count()  # starts the JVM's work, not measured

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
