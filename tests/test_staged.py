"""Rewrites that commit at once, and the jobs that use them."""

import json

import pytest
from pyspark.sql import functions as F

from postpulse.operators.relevance import parse_labels
from postpulse.plans import jobs
from postpulse.sources import lake, payloads
from postpulse.sources.staged import commit, current, rewrite, table_path
from postpulse.streaming import live

STAMP = "2024-03-01 00:00:00"


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and p.suffix != ".crc")


def numbers(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).collect())


def test_readers_follow_whole_manifests_only(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/a")
    spark.range(4).write.parquet(f"{root}/b")
    write = lambda rows, folder: rows.write.parquet(folder)

    def dies(rows, folder):
        write(rows, folder)
        raise RuntimeError("killed")

    before = files_below(tmp_path)
    with pytest.raises(RuntimeError):
        rewrite(spark, root, {"a": (spark.range(30, 31), write), "b": (spark.range(40, 41), dies)}, run="dead")
    assert [numbers(spark, table_path(spark, root, t)) for t in "ab"] == [[0, 1, 2], [0, 1, 2, 3]]
    assert [f for f in files_below(tmp_path) if not f.startswith("_staged/")] == before

    rewrite(spark, root, {"a": (spark.range(30, 31), write), "b": (spark.range(40, 41), write)}, run="one")
    assert [numbers(spark, table_path(spark, root, t)) for t in "ab"] == [[30], [40]]
    (tmp_path / "_manifests" / "000000000001.json").write_text('{"a": "_sta')  # its writer was stopped
    assert numbers(spark, table_path(spark, root, "a")) == [30]
    for n in (2, 3, 4):
        rewrite(spark, root, {"a": (spark.range(n, n + 1), write)}, run=f"run{n}")
    assert numbers(spark, table_path(spark, root, "a")) == [4] and numbers(spark, table_path(spark, root, "b")) == [40]
    assert (tmp_path / "_staged" / "run3").exists() and not list((tmp_path / "_staged" / "run2").rglob("*.parquet"))
    assert numbers(spark, f"{root}/a") == [0, 1, 2]  # never staged: left to its owner


def test_two_writers_of_one_number(spark, tmp_path):
    commit(spark, str(tmp_path), {"a": "x"})
    (tmp_path / "_manifests" / "000000000001.json").write_text('{"a": "y"}')
    assert commit(spark, str(tmp_path), {"b": "z"}) == 2
    assert current(spark, str(tmp_path)) == {"a": "y", "b": "z"}


@pytest.fixture
def stored(spark, tmp_path):
    """A lake with topics out of date."""
    rows = [(str(i), text, "old", source, "positive") for i, (text, source) in enumerate([
        ("Banxico mantiene la tasa de interés por inflación", "twitter_live"), ("Tariffs and war fear hit global trade", "twitter_live"),
        ("Crude oil gains while opec holds output", "manual_upload")])]
    df = spark.createDataFrame(rows, "tweet_id string, clean_text string, topic string, source string, sentiment string").withColumns(
        {"text": F.col("clean_text"), "created_at": F.to_timestamp(F.lit("2024-01-02 03:04:05"))})
    root = str(tmp_path / "lake")
    df.write.parquet(f"{root}/{jobs.PROCESSED_PATH}")
    silver = lake.conform_silver(df, source=F.col("source"), run_id="r1", ingestion_date="2024-01-02")
    lake.write_silver(silver, root)
    live.write_latest(silver.filter("source = 'twitter_live'"), root)
    return root, tmp_path / "lake"


def topics(df):
    return {r["tweet_id"]: r["topic"] for r in df.collect()}


NEW = {"0": "monetary_policy", "1": "geopolitical_risk", "2": "commodities_energy"}


def test_reprocess_lake(spark, stored):
    root, folder = stored
    before = files_below(folder)
    planned = jobs.reprocess_lake(spark, root, stamp=STAMP, dry_run=True)
    assert topics(planned[jobs.PROCESSED_PATH]) == NEW and files_below(folder) == before

    done = jobs.reprocess_lake(spark, root, stamp=STAMP)
    live_only = {k: NEW[k] for k in "01"}
    assert topics(done[jobs.PROCESSED_PATH]) == NEW
    assert topics(live.read_latest(spark, root, lake.SILVER)) == topics(done[live.LATEST_PATH]) == live_only
    assert topics(lake.read_silver(spark, root)) == {**live_only, "2": "old"}
    assert {r["tweet_id"]: r["reprocessed_at"] for r in done[lake.SILVER_PATH].collect()} == {"0": STAMP, "1": STAMP, "2": None}
    # later writers go on in the new tables
    more = lake.read_silver(spark, root).filter("tweet_id = '1'").withColumns({"run_id": F.lit("r2"), "tweet_id": F.lit("9")})
    lake.write_silver(more, root)
    assert topics(lake.read_silver(spark, root)) == {**live_only, "2": "old", "9": "geopolitical_risk"}
    live.write_latest(more, root)
    assert set(topics(live.read_latest(spark, root, lake.SILVER))) == {"9"}
    jobs.reprocess_lake(spark, root, stamp="again")
    assert {r["reprocessed_at"] for r in spark.read.parquet(live.latest_folder(spark, root)).collect()} == {"again"}


def test_reprocess_killed_half_way_shows_the_old_tables(spark, stored, monkeypatch):
    root, _ = stored
    monkeypatch.setattr(lake, "write_runs", lambda rows, folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jobs.reprocess_lake(spark, root, stamp=STAMP)
    assert set(topics(lake.read_silver(spark, root)).values()) == {"old"}
    assert set(topics(live.read_latest(spark, root, lake.SILVER)).values()) == {"old"}
    assert table_path(spark, root, jobs.PROCESSED_PATH) == f"{root}/{jobs.PROCESSED_PATH}"


def test_empty_lake_has_nothing_to_reprocess(spark, tmp_path):
    assert jobs.reprocess_lake(spark, str(tmp_path), stamp=STAMP) == {}
    assert files_below(tmp_path) == []


def post(i, text, day="2024-01-02"):
    return {"id": str(i), "text": text, "created_at": f"{day}T00:00:0{i % 10}Z", "author_id": "7"}


@pytest.fixture
def captured(tmp_path):
    """Captures as an API client lands them: single, combined, empty and broken files."""
    folder = tmp_path / "lake" / "bronze" / "twitter_live"
    users = {"users": [{"id": "7", "username": "reuters"}]}
    single = {"data": [post(1, "Fed rates and inflation rise"), post(2, "")], "includes": users}
    pair = [{"data": [post(3, "Oil gains on opec output")], "includes": users}, {"data": [post(1, "Fed rates and inflation rise")]}]
    combined = {"user_query": "u", "queries": ["q one", "q two"], "responses": pair, "strategy": "s"}
    for day, run, body in [("2024-01-02", "twitter_live_nvda_1", json.dumps(single, indent=1)), ("2024-01-03", "twitter_consultas_live_2", json.dumps(combined)),
                           ("2024-01-03", "twitter_live_tsla_3", json.dumps({"data": None})), ("2024-01-03", "twitter_live_tsla_4", "{not json"),
                           ("2024-02-09", "twitter_live_late_5", json.dumps(single))]:
        (folder / f"ingestion_date={day}").mkdir(parents=True, exist_ok=True)
        (folder / f"ingestion_date={day}" / f"{run}.json").write_text(body)
    return str(tmp_path / "lake"), tmp_path / "lake"


def test_backfill_from_captures(spark, captured):
    root, folder = captured
    span = {"since": "2024-01-01", "until": "2024-01-31", "run_ts": "2024-02-01 00:00:00"}
    before = files_below(folder)
    planned = jobs.backfill_captures(spark, root, dry_run=True, **span).collect()
    assert sorted((r["run_id"], r["posts"]) for r in planned) == [("twitter_consultas_live_2", 2), ("twitter_live_nvda_1", 2)]
    assert files_below(folder) == before

    silver = jobs.backfill_captures(spark, root, **span)
    got = sorted((r["run_id"], r["tweet_id"], r["query_ticker"], r["relevance_score"], r["author_username"]) for r in silver.collect())
    assert got == [("twitter_consultas_live_2", "1", "UNMAPPED", 0.75, None), ("twitter_consultas_live_2", "3", "UNMAPPED", 0.75, "reuters"),
                   ("twitter_live_nvda_1", "1", "NVDA", 0.75, "reuters")]
    assert lake.read_gold(spark, root).agg(F.sum("total")).first()[0] == 3
    newest = sorted((r["tweet_id"], r["run_id"]) for r in live.read_latest(spark, root, lake.SILVER).collect())
    assert newest == [("1", "twitter_live_nvda_1"), ("3", "twitter_consultas_live_2")]
    assert jobs.backfill_captures(spark, root, dry_run=True, **span).collect() == []
    forced = jobs.backfill_captures(spark, root, dry_run=True, force=True, **span)
    assert forced.count() == 2
    jobs.backfill_captures(spark, root, **{**span, "until": "2024-12-31"}, latest_rows=1)
    assert live.read_latest(spark, root, lake.SILVER).count() == 1


def test_stream_reads_both_kinds_of_captures(spark, captured, tmp_path):
    root, _ = captured
    rows = payloads.flatten_captures(payloads.read_captures(spark, f"{root}/{jobs.BRONZE_PATH}"), ("run_id",)).collect()
    assert sorted((r["run_id"], r["tweet_id"], r["query"]) for r in rows if r["run_id"].endswith("2")) == [
        ("twitter_consultas_live_2", "1", "q two"), ("twitter_consultas_live_2", "3", "q one")]
    live.run_live_ingestion(spark, f"{root}/{jobs.BRONZE_PATH}", str(tmp_path / "out"), str(tmp_path / "progress"), run_ts="2024-02-01 00:00:00")
    runs = {(r["run_id"], r["tweet_id"]) for r in lake.read_silver(spark, str(tmp_path / "out")).collect()}
    assert ("twitter_consultas_live_2", "3") in runs and ("twitter_live_nvda_1", "1") in runs


def test_labels_in_any_fenced_block(spark):
    one = '{"tweet_id": "a", "is_noise": false, "relevance_score": 1, "reason": "x"}'
    answers = [
        f'```\n[{{"note": 1}}\n```\n```json\n[{one}, {one}]\n```', f"```\nno labels\n```\nso\n```\n{one}\n```\n", f"```json\n\n```\n```json\n[{one}]", "``` ```",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "n int, response string")
    rows = sorted((r["n"], r["label_pos"], r["tweet_id"]) for r in parse_labels(df).collect())
    assert rows == [(0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (2, 0, "a")]


def test_writes_leave_no_shuffle_files_and_the_setting_as_it_was(spark, tmp_path):
    from postpulse.session import FREED, store

    def shuffles():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {found.apply(i).name() for i in range(found.size()) if found.apply(i).name().startswith("shuffle_")}

    before, held = spark.conf.get(FREED, None), shuffles()
    rows = spark.range(5000).selectExpr("id % 100 AS k", "cast(id AS string) AS v").repartition(4, "v")
    stored = store(rows, f"{tmp_path}/t")
    assert not shuffles() - held and spark.conf.get(FREED, None) == before
    assert stored.count() == 5000
