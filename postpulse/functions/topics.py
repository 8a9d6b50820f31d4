"""Topic rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import contains_any, fold, let, remembered, string_array, text_or_empty, tokens


@remembered
def classify_topic(column: Column, *, keywords: Mapping[str, Sequence[str]] | None = None) -> Column:
    """First topic, in priority order, with any keyword hit.

    The token array is cut down to dictionary words once, so the per-topic tests
    run over a handful of strings however long the text is.
    """
    keywords = keywords or D.TOPIC_KEYWORDS
    phrases = {t: [k for k in ks if any(c in k for c in " /&")] for t, ks in keywords.items()}
    words = {t: [k for k in ks if k not in phrases[t]] for t, ks in keywords.items()}
    vocabulary = sorted({w for ws in words.values() for w in ws})

    def classify(folded: Column) -> Column:
        def first_topic(hits: Column) -> Column:
            return F.coalesce(
                *[
                    F.when(
                        F.arrays_overlap(hits, string_array(words[t]))
                        | contains_any(folded, phrases[t]),
                        F.lit(t),
                    )
                    for t in keywords
                ],
                F.lit(D.DEFAULT_TOPIC),
            )

        return let(F.filter(tokens(folded), lambda t: t.isin(vocabulary)), first_topic)

    return let(fold(text_or_empty(column)), classify)


def topic_by_label(label: Column, model_topic: Column | None = None) -> Column:
    """Topic name by integer label; without a label the model's topic, else 'Unknown'.

    A label that is out of range is 'Unknown' whatever the model says.
    """
    names = string_array(D.LABEL_TOPICS)
    in_range = (label >= 0) & (label < len(D.LABEL_TOPICS))
    by_label = F.when(in_range, F.get(names, label.cast("int"))).when(
        label.isNotNull(), F.lit("Unknown")
    )
    extra = [] if model_topic is None else [model_topic]
    return F.coalesce(by_label, *extra, F.lit("Unknown"))
