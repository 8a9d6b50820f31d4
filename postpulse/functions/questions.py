"""Features of a user's question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import anchors
from postpulse.functions import dictionaries as D
from postpulse.functions.text import (
    _FOLD_FROM, _FOLD_TO, contains_any, fold, let, remembered, squeeze, string_array, text_or_empty, tokens,
)

_PLAIN = str.maketrans(dict(zip(_FOLD_FROM, _FOLD_TO)))
_MACRO_MARKERS = [
    t.lower().translate(_PLAIN)
    for t in (*D.MACRO_TERMS["en"], *D.MACRO_TERMS["es"], *D.MACRO_EXTRA_MARKERS)
]


@remembered
def language_hint(column: Column) -> Column:
    return F.when(contains_any(fold(text_or_empty(column)), D.SPANISH_MARKERS), "es").otherwise("en")


@remembered
def is_macro(column: Column) -> Column:
    return contains_any(fold(text_or_empty(column)), _MACRO_MARKERS)


def search_terms(column: Column, language: Column | str, limit: int = 10) -> Column:
    """Content words of a question plus fixed expansions, first ``limit`` distinct."""
    language = F.lit(language) if isinstance(language, str) else language
    words = tokens(text_or_empty(column), "[$A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+")

    def keep(word: Column) -> Column:
        plain = F.ltrim(fold(word), F.lit("$"))
        stop = F.when(language == "es", plain.isin(list(D.QUESTION_STOP_WORDS["es"]))).otherwise(
            plain.isin(list(D.QUESTION_STOP_WORDS["en"]))
        )
        return (F.length(plain) > 2) & ~stop

    folded = fold(text_or_empty(column))
    none = F.array().cast("array<string>")
    mexico = F.when(
        contains_any(folded, ("mexico", "banxico")), string_array(D.MEXICO_EXPANSION)
    ).otherwise(none)
    trump = F.when(F.contains(folded, F.lit("trump")), string_array(D.TRUMP_EXPANSION)).otherwise(none)
    return F.slice(F.array_distinct(F.concat(F.filter(words, keep), mexico, trump)), 1, limit)


@remembered
def anchor_selection(question: Column) -> Column:
    """Group names of a precise search, in clause order: one place, two named
    entities, one rating code, two themes.  Null unless at least two remain, or
    when the question already is a boolean expression."""
    raw = F.trim(text_or_empty(question))
    boolean = F.contains(raw, F.lit(" OR ")) | contains_any(raw, ("(", ")"))

    def select(groups: Column) -> Column:
        def of(*kinds: str) -> Column:
            return F.filter(groups, lambda g: g["kind"].isin(list(kinds)))

        chosen = F.slice(
            F.concat(
                F.slice(of("country", "region"), 1, 1),
                F.slice(of("company", "central_bank", "rating_agency"), 1, 2),
                F.slice(of("rating_code"), 1, 1),
                F.slice(of("theme"), 1, 2),
            ),
            1, 5,
        )
        return let(chosen, lambda c: F.when((F.size(c) >= 2) & ~boolean, anchors.names(c)))

    return let(anchors.with_implied_context(anchors.anchor_groups(raw)), select)


@remembered
def refine(question: Column) -> Column:
    """``struct(original, refined, reason)`` of a question made finance-aware."""
    raw = F.trim(text_or_empty(question))
    lowered = F.lower(raw)

    def result(refined: Column, reason: str) -> Column:
        return F.struct(
            raw.alias("original"), refined.alias("refined"), F.lit(reason).alias("reason")
        )

    chain = F.when(raw == "", result(raw, "empty query")).when(
        anchor_selection(raw).isNotNull(), result(raw, "strong_anchors_preserved")
    )
    for key, expansion in D.ENTITY_EXPANSIONS.items():
        chain = chain.when(
            F.contains(lowered, F.lit(key)),
            result(F.lit(expansion), f"expanded entity '{key}' with finance terms"),
        )
    return chain.when(
        contains_any(lowered, [t.lower() for t in D.CONTEXT_TERMS]),
        result(raw, "already has financial context"),
    ).otherwise(
        result(
            F.concat(F.lit("("), raw, F.lit(") " + D.GENERIC_EXPANSION)),
            "added generic financial context",
        )
    )


@remembered
def refine_for_corpus(question: Column) -> Column:
    """Same refinement with the boolean syntax removed from changed questions."""

    def strip(r: Column) -> Column:
        bare = F.regexp_replace(r["refined"], r'[()"]', " ")
        bare = F.regexp_replace(bare, r"(?i)(?<![\p{L}\p{N}_])OR(?![\p{L}\p{N}_])", " ")
        bare = squeeze(bare)
        changed = r["refined"] != r["original"]
        return F.struct(
            r["original"].alias("original"),
            F.when(changed, bare).otherwise(r["refined"]).alias("refined"),
            r["reason"].alias("reason"),
        )

    return let(refine(question), strip)
