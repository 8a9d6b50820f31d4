"""Nothing is lost: repeated texts, runs, snapshots, rewrites, searches and topic counts."""

import json

from pyspark.sql import functions as F

from postpulse.functions.models import TaggingTranslator
from postpulse.operators import aggregates as A, cleaning as C, enrich as E, saved_search as S
from postpulse.plans import jobs
from postpulse.sources import lake, posts, schema, tables
from postpulse.streaming import live


def test_equal_rows_get_ids_of_their_own(spark):
    df = spark.createDataFrame([("same",)] * 50 + [("other",), (None,)], "text string").repartition(6)
    found = C.with_surrogate_ids(df, "tweet_id", ["text"])
    ids = sorted(r["tweet_id"] for r in found.collect())
    assert len(set(ids)) == 52
    again = C.with_surrogate_ids(df.coalesce(1), "tweet_id", ["text"])
    assert sorted(r["tweet_id"] for r in again.collect()) == ids
    repaired = C.repair_ids(df.withColumn("id", F.when(F.col("text") == "other", F.lit("k"))))
    assert repaired.select("tweet_id").distinct().count() == 52


def test_upload_keeps_repeated_texts(spark, tmp_path):
    path = f"{tmp_path}/up.csv"
    same = "Stock outlook is strong and earnings look good for the whole quarter"
    tables.write_table(spark.createDataFrame([(same,)] * 5 + [("Bonds fall on debt risk, says a long note on credit",)], "text string"), path)
    up = jobs.ingest_upload(spark, path, f"{tmp_path}/lake", run_id="r", run_ts="2026-05-20 00:00:00")
    assert up.processed.count() == 6


def test_rewrites_have_no_cap_unless_one_is_asked_for(spark):
    df = spark.createDataFrame([(f"{r}-{i}", r, "el peso sube", i) for r in "abc" for i in range(30)],
                               "tweet_id string, run_id string, text string, o int")

    def rewritten(**options):
        out = E.with_rewrites(df, TaggingTranslator(), order="tweet_id", **options)
        done = out.filter("translation_reason = 'non_english_financial_text'")
        return out.count(), sorted(tuple(r) for r in done.groupBy("run_id").count().collect())

    assert rewritten() == (90, [("a", 30), ("b", 30), ("c", 30)])
    assert rewritten(cap=25, by=["run_id"]) == (90, [("a", 25), ("b", 25), ("c", 25)])


def _post(i, text="Nvidia stock earnings are strong"):
    return {"data": [{"id": str(i), "text": text, "created_at": f"2026-05-20T0{i}:00:00Z"}]}


def test_a_post_of_two_runs_is_in_both_however_files_are_batched(spark, tmp_path):
    landing = tmp_path / "landing" / "ingestion_date=2026-05-20"
    landing.mkdir(parents=True)
    for run in (1, 2):
        (landing / f"twitter_live_nvda_{run}.json").write_text(json.dumps(_post(1)))
    found = []
    for files in ("1", "10"):
        root = str(tmp_path / f"lake{files}")
        live.run_live_ingestion(spark, str(tmp_path / "landing"), root, str(tmp_path / f"progress{files}"),
                                run_ts="2026-05-21 00:00:00", source_options={"maxFilesPerTrigger": files})
        silver = lake.read_silver(spark, root)
        gold = lake.read_gold(spark, root).agg(F.sum("total")).first()[0]
        found.append((silver.count(), gold, live.read_latest(spark, root, lake.SILVER).count()))
    assert found == [(2, 2, 1), (2, 2, 1)]


def test_a_new_checkpoint_does_not_hide_newer_posts(spark, tmp_path):
    root = str(tmp_path / "lake")
    for i in (1, 2, 3, 4):
        landing = tmp_path / f"landing{i}" / "ingestion_date=2026-05-20"
        landing.mkdir(parents=True)
        (landing / f"twitter_live_nvda_{i}.json").write_text(json.dumps(_post(i)))
        live.run_live_ingestion(spark, str(tmp_path / f"landing{i}"), root, str(tmp_path / f"progress{i}"), run_ts="2026-05-21 00:00:00")
    latest = live.read_latest(spark, root, lake.SILVER)
    assert sorted(r["tweet_id"] for r in latest.collect()) == ["1", "2", "3", "4"]
    assert len(latest.inputFiles()) >= 1
    assert {f.split("version=")[1].split("/")[0] for f in latest.inputFiles()} == {"3"}


def test_empty_questions_have_no_search(spark):
    asked = spark.createDataFrame([(1, ""), (2, "  "), (3, "Apple sales")], "question_id int, question string")
    for build in (S.broad_searches, S.loose_searches):
        assert [r["question_id"] for r in build(asked).collect()] == [3]


def test_long_terms_and_many_clauses(spark):
    found = spark.createDataFrame([("1", "one two three four five six seven"), ("2", "one two three four five six")], "tweet_id string, text string")
    words = [["one two three four five six seven"], *[["one"]] * 40]
    schema_of = "clauses array<array<string>>, lang string, excluded_terms array<string>, only_authors array<string>, excluded_authors array<string>"
    search = spark.createDataFrame([(words, None, ["absent"], None, [])], schema_of)
    assert [r["tweet_id"] for r in S.match_searches(found, search).collect()] == ["1"]
    missing = spark.createDataFrame([([*words, ["absent"]], None, ["nothing"], None, [])], schema_of)
    assert S.match_searches(found, missing).count() == 0


def test_passes_are_ranked_per_search_before_they_meet_questions(spark):
    rows = spark.createDataFrame([(str(i), "stock market outlook for today", "en", f"2026-05-{i + 1:02d}") for i in range(28)],
                                 "tweet_id string, text string, lang string, created_at string")
    asked = spark.createDataFrame([(q, "stock market outlook") for q in range(5)], "question_id int, question string")
    found = S.staged_search(rows, asked, max_results=10)
    assert sorted(r["count"] for r in found.groupBy("question_id").count().collect()) == [10] * 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("search_key") < plan.rindex("row_number")


def test_topic_shift_keeps_both_counts(spark):
    before = spark.createDataFrame([(f"t{i:02d}",) for i in range(20) for _ in range(40 - i)], "topic string")
    after = before.filter("topic <> 't00'")
    got = {r["topic"]: (r["before"], r["after"]) for r in A.topic_shift(before, after).collect()}
    assert len(got) == 16
    assert got["t15"] == (25, 25)
    assert got["t00"] == (40, None)


def test_profile_takes_the_same_values_whatever_the_partitions(spark):
    df = spark.createDataFrame([(f"word {i} stock", i) for i in range(900)], "content string, label int")
    first = schema.content_profile(df.repartition(7)).orderBy("column").collect()
    assert first == schema.content_profile(df.coalesce(1).orderBy(F.desc("label"))).orderBy("column").collect()


def test_every_own_word_is_in_posts_and_questions(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert posts.event_posts(spark, sf).filter(F.col("text").contains("\n")).count() == events.count()
    asked = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'")
    joined = posts.questions(spark, sf).join(asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text"), "question_id")
    assert joined.filter(~F.col("question").endswith(F.col("text"))).count() == 0
