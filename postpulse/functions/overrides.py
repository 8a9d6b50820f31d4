"""Rules applied after scoring, and the test for texts worth rewriting first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import any_substring, contains_any, hits, remembered, text_or_empty

_TEXT_COLUMNS = ("text", "clean_text", "title", "summary")


def apply_overrides(df: DataFrame) -> DataFrame:
    """Rating and macro corrections of topic, sentiment and confidence.

    Works on plain lower-case substrings of every text column the frame has.  A
    missing or NaN confidence counts as 0 before the floor is applied.
    """
    present = [c for c in _TEXT_COLUMNS if c in df.columns]
    if not present:
        return df
    found, rating, macro, tone = "_ovr_hits", "_ovr_rating", "_ovr_macro", "_ovr_tone"
    columns = df.columns

    lists = (D.OVERRIDE_RATING, D.OVERRIDE_MACRO, D.OVERRIDE_NEGATIVE, D.OVERRIDE_POSITIVE)
    lowered = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in present]))
    staged = df.withColumn(found, hits(lowered, [any_substring(terms) for terms in lists]))
    staged = staged.withColumns({
        rating: F.array_contains(found, 0),
        macro: F.array_contains(found, 1),
        tone: F.when(F.array_contains(found, 2), "negative")
        .when(F.array_contains(found, 3), "positive")
        .otherwise("neutral"),
    })

    topic = text_or_empty(F.col("topic")) if "topic" in columns else F.lit("")
    old_topic = F.col("topic") if "topic" in columns else F.lit(None).cast("string")
    old_label = F.col("sentiment") if "sentiment" in columns else F.lit(None).cast("string")
    old_conf = (
        F.col("sentiment_confidence").cast("double")
        if "sentiment_confidence" in columns
        else F.lit(None).cast("double")
    )
    floor = F.when(F.col(tone) == "negative", D.OVERRIDE_CONFIDENCE["negative"]).when(
        F.col(tone) == "positive", D.OVERRIDE_CONFIDENCE["positive"]
    ).otherwise(D.OVERRIDE_CONFIDENCE["neutral"])
    usable = F.nanvl(F.coalesce(old_conf, F.lit(0.0)), F.lit(0.0))

    out = staged.withColumns({
        "topic": F.when(F.col(rating), "sovereign_credit_rating")
        .when(F.col(macro) & F.trim(topic).isin(list(D.OVERRIDE_MACRO_TOPICS)), "monetary_policy")
        .otherwise(old_topic),
        "sentiment": F.when(F.col(rating), F.col(tone)).otherwise(old_label),
        "sentiment_confidence": F.when(F.col(rating), F.greatest(usable, floor)).otherwise(old_conf),
    })
    return out.drop(found, rating, macro, tone)


@remembered
def rewrite_candidate(column: Column) -> Column:
    """A finance hint together with a Spanish hint or any non-ASCII character."""
    lowered = F.lower(text_or_empty(column))
    foreign = contains_any(lowered, D.REWRITE_SPANISH_HINTS) | lowered.rlike(r"[^\x00-\x7F]")
    return contains_any(lowered, D.REWRITE_FINANCE_HINTS) & foreign
