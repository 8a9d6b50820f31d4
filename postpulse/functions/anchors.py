"""Named entities and themes ("anchors") of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import (
    any_substring, any_token, fold, hits, let, remembered, text_or_empty, _FOLD_FROM, _FOLD_TO,
)

AnchorRows = Sequence[tuple[str, str, Sequence[str]]]
_KIND = {name: kind for name, kind, _ in D.ANCHOR_GROUPS}
_PLAIN = str.maketrans(dict(zip(_FOLD_FROM, _FOLD_TO)))


def _normal_term(term: str) -> str:
    plain = term.lower().translate(_PLAIN)
    return " ".join(plain.replace("+", " ").replace("’", "'").split())


def _normalize(column: Column) -> Column:
    # white space stays as it is: the patterns take any of it for a blank
    return F.translate(fold(text_or_empty(column)), "+’", " '")


@remembered
def anchor_groups(
    column: Column, *, with_implied: bool = False, groups: AnchorRows | None = None
) -> Column:
    """``array<struct(name, kind)>`` in group order.

    Cashtags and terms of at most three characters (without blank or slash) are
    whole tokens; longer terms are substrings.  ``with_implied`` also tests the
    rating-context group, which a question never names by itself.
    """
    rows = [g for g in (groups or D.ANCHOR_GROUPS) if with_implied or g[0] != D.IMPLIED_GROUP]
    patterns = []
    for _name, _kind, terms in rows:
        plain = [t for t in dict.fromkeys(_normal_term(t) for t in terms) if t]
        short = [
            t for t in plain
            if t.startswith("$") or (len(t) <= 3 and " " not in t and "/" not in t)
        ]
        long = [t for t in plain if t not in short]
        patterns.append("|".join(p for p in (any_substring(long, loose=True), any_token(short, "a-z0-9$")) if p))
    named = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, _terms in rows
    ])
    return F.transform(hits(_normalize(column), patterns), lambda i: F.get(named, i))


def names(groups: Column) -> Column:
    return F.transform(groups, lambda g: g["name"])


def with_implied_context(groups: Column) -> Column:
    """A rating agency next to an entity, without any rating word, implies one more group."""

    def augment(g: Column) -> Column:
        has_agency = F.exists(g, lambda x: x["kind"] == "rating_agency")
        has_entity = F.exists(
            g, lambda x: x["kind"].isin("country", "region", "company", "central_bank", "rating_code")
        )
        has_context = F.exists(g, lambda x: x["name"].isin("credit_rating_theme", "rating_codes"))
        implied = F.array(F.struct(
            F.lit(D.IMPLIED_GROUP).alias("name"), F.lit(_KIND[D.IMPLIED_GROUP]).alias("kind")
        ))
        return F.when(has_agency & has_entity & ~has_context, F.concat(g, implied)).otherwise(g)

    return let(groups, augment)


def required_count(augmented: Column) -> Column:
    """How many of the question's groups a post must keep (takes augmented groups)."""

    def count(g: Column) -> Column:
        has_entity = F.exists(g, lambda x: x["kind"].isin(list(D.ENTITY_KINDS)))
        implied = F.exists(g, lambda x: x["name"] == D.IMPLIED_GROUP)
        return (
            F.when(F.size(g) == 0, 0)
            .when(implied, 3)
            .when((F.size(g) >= 2) & has_entity, 2)
            .otherwise(1)
        )

    return let(augmented, count)


def match_count(text: Column, question_groups: Column) -> Column:
    """Number of the question's groups that the text satisfies."""
    return F.size(F.array_intersect(
        names(anchor_groups(text, with_implied=True)), names(question_groups)
    ))
