"""Row enrichment: the processed-post pipeline, model scoring, selective rewriting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postpulse.functions.models import Scorer, Translator
from postpulse.functions.overrides import apply_overrides, rewrite_candidate
from postpulse.functions.sentiment import LABELS, lexicon_sentiment
from postpulse.functions.text import string_array, text_or_empty
from postpulse.functions.tickers import extract_tickers, primary_ticker
from postpulse.functions.topics import classify_topic
from postpulse.operators.answers import with_answers
from postpulse.operators.cleaning import add_clean_text, with_defaults
from postpulse.operators.joins import keep_first

SENTIMENT_COLUMNS = ("sentiment", "sentiment_score", "positive_hits", "negative_hits")
MODEL_BATCH = 16


def with_tickers(df: DataFrame, column: str = "clean_text") -> DataFrame:
    return df.withColumn("tickers", extract_tickers(F.col(column))).withColumn(
        "primary_ticker", primary_ticker(F.col("tickers"))
    )


def with_lexicon_sentiment(df: DataFrame, column: str = "clean_text") -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"input needs a '{column}' column")
    scored = df.withColumn("_lex", lexicon_sentiment(F.col(column)))
    return scored.withColumns({c: F.col("_lex")[c] for c in SENTIMENT_COLUMNS}).drop("_lex")


def with_topic(df: DataFrame) -> DataFrame:
    column = "clean_text" if "clean_text" in df.columns else "text"
    return df.withColumn("topic", classify_topic(F.col(column)))


def model_probabilities(column: Column, scorer: Scorer, batch_size: int = MODEL_BATCH) -> Column:
    """``array<double>`` in the order of ``scorer.labels``."""

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer.load()
        for batch in batches:
            texts = [t.strip() for t in batch]
            rows: list = []
            for start in range(0, len(texts), batch_size):
                rows.extend(model(texts[start : start + batch_size]).tolist())
            yield pd.Series(rows, index=batch.index)

    # Marked so that the planner neither repeats a model call nor moves it into the
    # branches of a union.
    return predict.asNondeterministic()(text_or_empty(column))


def with_model_sentiment(
    df: DataFrame, scorer: Scorer, column: str = "clean_text", batch_size: int = MODEL_BATCH, store: str | None = None
) -> DataFrame:
    """Label, confidence and class probabilities of a pluggable model.  With a ``store`` of
    answers (see ``answers``) each text is scored once, over all rows and runs.

    Only the probabilities come from Python; arg-max (first wins), missing classes
    (0.0) and the score stay in the engine.
    """
    if column not in df.columns:
        raise ValueError(f"input needs a '{column}' column")
    labels = [label.lower() for label in scorer.labels]
    if store:
        scored = with_answers(df, column, "_probs", store=store, model=scorer.name, kind=T.ArrayType(T.DoubleType()),
                              ask=lambda text: model_probabilities(text, scorer, batch_size).cast("array<double>"))
    else:
        scored = df.withColumn("_probs", model_probabilities(F.col(column), scorer, batch_size))
    best = F.array_max("_probs")

    def prob(label: str) -> Column:
        if label not in labels:
            return F.lit(0.0)
        return F.get(F.col("_probs"), F.lit(labels.index(label)))

    return scored.withColumns({
        "sentiment": F.element_at(string_array(labels), F.array_position("_probs", best).cast("int")),
        "sentiment_confidence": best,
        "positive_prob": prob("positive"),
        "neutral_prob": prob("neutral"),
        "negative_prob": prob("negative"),
        "sentiment_score": prob("positive") - prob("negative"),
        "sentiment_model": F.lit(scorer.name),
    }).drop("_probs")


def with_sentiment(df: DataFrame, model: str = "lexicon", scorer: Scorer | None = None) -> DataFrame:
    """'finbert' scores with the given model; any other name uses the lexicon."""
    if model.lower() == "finbert":
        if scorer is None:
            raise ValueError("model scoring needs a scorer")
        return with_model_sentiment(df, scorer)
    empty = {f"{label}_prob": F.lit(None).cast("double") for label in LABELS}
    return with_lexicon_sentiment(df).withColumns({
        "sentiment_confidence": F.lit(None).cast("double"),
        **empty,
        "sentiment_model": F.lit("lexicon"),
    })


def process_posts(
    df: DataFrame,
    *,
    run_ts: Column | str = "1970-01-01 00:00:00",
    order: str | None = None,
    model: str = "lexicon",
    scorer: Scorer | None = None,
) -> DataFrame:
    """Raw posts to processed posts: clean, default, tag, score, one row per id.

    Dictionary rules are evaluated below the deduplication so that an aggregate on
    top shuffles labels, not texts.  A model is expensive, so it runs above it.
    ``order`` names the column that decides which duplicate is the first.
    """
    # Rows whose clean text is empty rank last among their duplicates and are dropped
    # above the ranking: same rows as filtering first, but the cleaning expression is
    # not evaluated a second time inside a pushed-down filter.
    prepared = with_defaults(add_clean_text(df), run_ts)
    prepared = with_tickers(prepared).withColumns({
        "doc_id": F.col("tweet_id").cast("string"),
        "_empty": F.length("clean_text") == 0,
    })
    tie_break = ["_empty", order] if order else ["_empty", "created_at", "text"]
    scored_first = model.lower() != "finbert"
    tagged = with_topic(with_sentiment(prepared, model) if scored_first else prepared)
    unique = keep_first(tagged, ["doc_id"], tie_break).filter(~F.col("_empty")).drop("_empty")
    return unique if scored_first else with_sentiment(unique, model, scorer)


def with_rewrites(
    df: DataFrame,
    translator: Translator | None,
    *,
    order: str,
    cap: int | None = None,
    by: Sequence[str] = (),
    disabled: bool = False,
    store: str | None = None,
) -> DataFrame:
    """Rewrite candidate texts in place, with an audit trail per row.  With a ``store`` of answers
    (see ``answers``) each text is sent once; a failure is sent again by the next run.

    Adds original_text, model_input_text, translation_model and translation_reason.  All
    candidates are rewritten; a caller who pays per text can set ``cap``, the number of
    candidates rewritten of each ``by`` group (a run, a question), the first in ``order``.
    """
    base = df.withColumn("original_text", text_or_empty(F.col("text")))
    if disabled or translator is None:
        return base.withColumns({
            "model_input_text": F.col("original_text"),
            "translation_model": F.lit("none"),
            "translation_reason": F.lit("disabled" if disabled else "not_translated"),
        })
    candidate = F.coalesce(rewrite_candidate(F.col("original_text")), F.lit(False))
    chosen, rest = base.filter(candidate), base.filter(~candidate)
    if cap is not None:
        group = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))
        chosen = chosen.withColumn("_rw_rank", F.row_number().over(group.orderBy(F.col(order).asc_nulls_last())))
        rest = rest.unionByName(chosen.filter(F.col("_rw_rank") > cap).drop("_rw_rank"))
        chosen = chosen.filter(F.col("_rw_rank") <= cap).drop("_rw_rank")

    @F.pandas_udf("struct<text:string,error:string>")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = translator.load()
        for batch in batches:
            rows = []
            for text in batch:
                try:
                    rows.append((None if text is None else (call(text) or "").strip(), None))
                except Exception as error:  # the row passes through, the reason is kept
                    rows.append((None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["text", "error"])

    ask = rewrite.asNondeterministic()
    asked = chosen.withColumn("_rw", ask("original_text")) if not store else with_answers(
        chosen, "original_text", "_rw", store=store, model=translator.name, ask=ask, failed=lambda a: a["error"].isNotNull(),
        kind=T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]),
    )
    done = asked.select(
        *base.columns, F.col("_rw.text").alias("_rw_text"), F.col("_rw.error").alias("_rw_error")
    )
    passed = rest.withColumns({
        "_rw_text": F.lit(None).cast("string"), "_rw_error": F.lit(None).cast("string"),
    })
    ok = F.length("_rw_text") > 0
    failed = F.col("_rw_error").isNotNull()
    return done.unionByName(passed).withColumns({
        "model_input_text": F.when(ok, F.col("_rw_text")).otherwise(F.col("original_text")),
        "translation_model": F.when(failed, "failed").when(ok, translator.name).otherwise("none"),
        "translation_reason": F.when(failed, F.col("_rw_error"))
        .when(ok, "non_english_financial_text")
        .otherwise("not_translated"),
    }).drop("_rw_text", "_rw_error")


def process_with_rewrites(
    df: DataFrame,
    translator: Translator | None,
    *,
    order: str,
    run_ts: Column | str = "1970-01-01 00:00:00",
    cap: int | None = None,
    by: Sequence[str] = (),
    disabled: bool = False,
    model: str = "lexicon",
    scorer: Scorer | None = None,
) -> DataFrame:
    """Score the rewritten text, then restore the original and apply the overrides.

    Every row carries its own original, so dropped or deduplicated rows cannot shift it.
    """
    rewritten = with_rewrites(df, translator, order=order, cap=cap, by=by, disabled=disabled)
    processed = process_posts(
        rewritten.withColumn("text", F.col("model_input_text")),
        run_ts=run_ts, order=order, model=model, scorer=scorer,
    )
    return apply_overrides(processed.withColumn("text", F.col("original_text")))


def reprocess(df: DataFrame, stamp: Column | str) -> DataFrame:
    """Recompute topic and overrides of already processed rows."""
    if "clean_text" not in df.columns and "text" in df.columns:
        df = df.withColumn("clean_text", F.col("text").cast("string"))
    stamp = F.lit(stamp) if isinstance(stamp, str) else stamp
    return apply_overrides(with_topic(df)).withColumn("reprocessed_at", stamp)
