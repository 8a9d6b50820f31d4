"""Lexicon sentiment with one-token negation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import let, remembered, round4, text_or_empty, tokens

LABELS = ("positive", "neutral", "negative")
THRESHOLD = 0.25
_LETTERS = "[a-záéíóúñ]+"


@remembered
def lexicon_sentiment(column: Column) -> Column:
    """``struct(sentiment, sentiment_score, positive_hits, negative_hits)``.

    A negation swaps the polarity of the token right after it, so a token's sign
    depends on its left neighbour only and no running state is needed.  Hits are
    divided by the square root of all tokens; the label uses the unrounded score.
    """

    def score(words: Column) -> Column:
        def hits(plain: tuple[str, ...], swapped: tuple[str, ...]) -> Column:
            def counts(word: Column, i: Column) -> Column:
                negated = (i > 0) & F.get(words, i - 1).isin(list(D.NEGATION_WORDS))
                return (word.isin(list(plain)) & ~negated) | (word.isin(list(swapped)) & negated)

            return F.size(F.filter(words, counts))

        measured = F.struct(
            hits(D.POSITIVE_WORDS, D.NEGATIVE_WORDS).alias("pos"),
            hits(D.NEGATIVE_WORDS, D.POSITIVE_WORDS).alias("neg"),
            F.size(words).alias("n"),
        )

        def label(m: Column) -> Column:
            raw = (m["pos"] - m["neg"]) / F.greatest(F.sqrt(m["n"]), F.lit(1.0))
            return F.struct(
                F.when(raw >= THRESHOLD, "positive")
                .when(raw <= -THRESHOLD, "negative")
                .otherwise("neutral")
                .alias("sentiment"),
                round4(raw).alias("sentiment_score"),
                m["pos"].alias("positive_hits"),
                m["neg"].alias("negative_hits"),
            )

        return let(measured, label)

    return let(tokens(F.lower(text_or_empty(column)), _LETTERS), score)


def count_label(label: str, column: str = "sentiment") -> Column:
    """Conditional count: one pass and a fixed schema, where a pivot needs neither."""
    return F.count_if(F.col(column) == label)
