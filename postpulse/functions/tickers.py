"""Company recognition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import dictionaries as D
from postpulse.functions.text import (
    WORD, constant_map, contains_any, let, remembered, string_array, tokens,
)

UNMAPPED = "UNMAPPED"


@remembered
def extract_tickers(column: Column, *, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sorted distinct symbols: a known symbol as a whole word (any case), or one
    of its aliases anywhere in the text.

    The cashtag of every symbol is one of its aliases, so the cashtag rule needs
    no test of its own.  Aliases are substrings on purpose ("melon" holds "elon").
    """
    aliases = aliases or D.TICKER_ALIASES
    symbols = sorted(aliases)
    whole_word = rf"(?<!{WORD})(?:{'|'.join(s.lower() for s in symbols)})(?!{WORD})"

    def hits(lowered: Column) -> Column:
        # a whole word is a substring first, and that test is much cheaper
        words = F.when(
            contains_any(lowered, [s.lower() for s in symbols]),
            F.regexp_extract_all(lowered, F.lit(whole_word), F.lit(0)),
        ).otherwise(string_array(()))

        def collect(found: Column) -> Column:
            return F.array_compact(F.array(*[
                F.when(
                    contains_any(lowered, aliases[s]) | F.array_contains(found, s.lower()),
                    F.lit(s),
                )
                for s in symbols
            ]))

        return let(words, collect)

    return let(F.lower(column), hits)


def primary_ticker(tickers: Column) -> Column:
    return F.coalesce(F.get(tickers, F.lit(0)), F.lit(UNMAPPED))


@remembered
def extract_tickers_legacy(column: Column) -> Column:
    """Runs of 2-5 capitals, optional cashtag, text order and repeats kept, minus stop words.

    A run may start inside a word but must end at a word boundary.
    """
    found = F.regexp_extract_all(column, F.lit(rf"\$?[A-Z]{{2,5}}(?!{WORD})"), F.lit(0))
    bare = F.transform(found, lambda t: F.ltrim(t, F.lit("$")))
    return F.filter(bare, lambda t: ~t.isin(list(D.LEGACY_TICKER_STOP)))


@remembered
def infer_company(column: Column, *, companies: Sequence[dict] | None = None) -> Column:
    """First catalog company whose name or symbol occurs in the text, else null.

    Names of one or two characters must be whole tokens; longer ones may be
    anywhere (so "coincidence" is COIN).  Catalog order decides.
    """
    companies = companies or D.COMPANIES

    def pick(upper: Column) -> Column:
        def choose(words: Column) -> Column:
            cases = []
            for company in companies:
                names = {a.upper().replace("$", " ").strip() for a in company["aliases"]}
                names.add(company["ticker"].upper())
                short = sorted(n for n in names if len(n) <= 2)
                long = sorted(n for n in names if len(n) > 2)
                test = contains_any(upper, long)
                if short:
                    test = test | F.arrays_overlap(words, string_array(short))
                cases.append(F.when(test, F.lit(company["ticker"])))
            return F.coalesce(*cases)

        return let(tokens(upper, "[A-Z0-9]+"), choose)

    return let(F.replace(F.upper(column), F.lit("$"), F.lit(" ")), pick)


def company_lookup(ticker: Column, field: str, companies: Sequence[dict] | None = None) -> Column:
    """A catalog field by ticker (null when unknown)."""
    companies = companies or D.COMPANIES
    return F.try_element_at(constant_map({c["ticker"]: c[field] for c in companies}), ticker)
