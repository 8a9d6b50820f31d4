"""Each text is sent to a model once."""

from pathlib import Path

from pyspark.sql import functions as F

from postpulse.functions.models import CountingScorer, TaggingTranslator
from postpulse.operators.enrich import with_model_sentiment, with_rewrites


def counting(log, name="first"):
    class Counting(CountingScorer):  # within a function: sent to the workers by value
        def load(self):
            predict = CountingScorer.load(self)

            def counted(texts):
                with Path(log).open("a") as out:
                    out.writelines(f"{t}\n" for t in texts)
                return predict(texts)

            return counted

    scorer = Counting()
    scorer.name = name
    return scorer


def failing(log, fail_on=None):
    class Failing(TaggingTranslator):
        def load(self):
            call = TaggingTranslator.load(self)

            def rewrite(text):
                with Path(log).open("a") as out:
                    out.write(f"{text}\n")
                return call(text)

            return rewrite

    return Failing(fail_on)


def lines(log):
    return sorted(Path(log).read_text().splitlines()) if Path(log).exists() else []


def test_equal_texts_cause_one_call_and_a_second_run_none(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    rows = [(i, "strong same text") for i in range(1000)] + [(1000, "risk"), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "ord int, clean_text string").repartition(6)
    plain = with_model_sentiment(df, CountingScorer()).drop("sentiment_model")
    for _ in range(2):
        got = with_model_sentiment(df, counting(log), store=store).drop("sentiment_model")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        assert lines(log) == ["", "risk", "strong same text"]
    with_model_sentiment(df.filter("ord > 998").withColumn("clean_text", F.lit("new")), counting(log), store=store).collect()
    assert lines(log) == ["", "new", "risk", "strong same text"]
    with_model_sentiment(df, counting(log, "another/model id"), store=store).collect()
    assert len(lines(log)) == 7


def test_failed_rewrites_are_sent_again(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    texts = ["Banxico mantiene la tasa de interés por inflación", "Peso mexicano sube frente al dólar", "plain words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "ord int, text string")
    first = with_rewrites(df, failing(log, "Peso"), order="ord", store=store).collect()
    assert {r["translation_model"] for r in first if "Peso" in r["original_text"]} == {"failed"}
    n = len(lines(log))
    again = with_rewrites(df, failing(log), order="ord", store=store)
    plain = with_rewrites(df, TaggingTranslator(), order="ord")
    assert sorted(map(str, again.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert [x for x in lines(log) if lines(log).count(x) == 2] == [texts[1]] * 2 and len(lines(log)) == n + 1
