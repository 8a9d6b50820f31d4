"""Text primitives as native Column expressions: cleaning, folding, tokens, substring tests."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace: the white-space property plus the four separators that only
# older definitions count.  Patterns using it need the (?U) flag in front.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


_UNIT = "\u001f"
_PLAIN_COLUMN = re.compile(r"^Column<'[A-Za-z_]\w*'>$")


def _fold_table() -> tuple[str, str]:
    """Every character below U+3000 (and full-width forms) whose compatibility
    decomposition without combining marks is one other character, followed by
    the combining marks themselves (deleted, as they have no counterpart)."""
    source, target, marks = [], [], []
    for code in [*range(0x80, 0x3000), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char and char == char.lower():
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


_RULES: dict = {}


def remembered(rule: Callable[[Column], Column]) -> Callable[..., Column]:
    """Keep the expression a rule built for a plain column name.

    The dictionaries make these expressions large; building one again for every frame
    costs more than planning it.  Only calls without options are kept.
    """

    @wraps(rule)
    def build(column: Column, **options) -> Column:
        name = str(column)
        context = SparkContext._active_spark_context
        if options or not _PLAIN_COLUMN.match(name):
            return rule(column, **options)
        key = (rule, name, id(context))
        if key not in _RULES:
            _RULES[key] = rule(column)
        return _RULES[key]

    return build


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


# Runs of whitespace other than a single blank: single blanks, the common case,
# need no replacement.
# The range in front rules out most characters by one comparison.
_LOOSE_SPACE = rf"(?U)(?=[^!-~])(?: {SPACE}+|[^\S ]{SPACE}*|[\x1c-\x1f]{SPACE}*)"


def squeeze(column: Column) -> Column:
    """Collapse runs of whitespace to one blank and strip both ends."""
    return F.trim(F.regexp_replace(column, _LOOSE_SPACE, " "))


@remembered
def clean_text(column: Column) -> Column:
    """Null becomes ''; URLs and mentions become blanks; whitespace is collapsed.

    Cashtags and hashtags survive.
    """

    # The byte searches in front of each regex are far cheaper than the regex, and
    # most texts hold no link or mention.
    def drop_urls(c: Column) -> Column:
        return F.when(
            contains_any(F.lower(c), ("://", "www.")),
            F.regexp_replace(c, rf"(?iU)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", " "),
        ).otherwise(c)

    def drop_mentions(c: Column) -> Column:
        return F.when(
            F.contains(c, F.lit("@")), F.regexp_replace(c, f"@{WORD}+", " ")
        ).otherwise(c)

    no_mentions = let(let(text_or_empty(column), drop_urls), drop_mentions)
    return squeeze(no_mentions)


# Pictographs, dingbats, flags, keycaps, variation selectors and joiners.
_EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{FE0F}\x{200D}\x{20E3}]"
)


@remembered
def clean_text_legacy(column: Column) -> Column:
    """Older cleaning: emoji, links, mentions and hashtags are deleted, not blanked."""
    # Plain ASCII holds no emoji, and each pattern begins with one of a few characters.
    def drop_emoji(c: Column) -> Column:
        return F.when(F.length(c) == F.octet_length(c), c).otherwise(
            F.regexp_replace(c, rf"(?=[^ -~]){_EMOJI}", "")
        )

    def drop_links(c: Column) -> Column:
        return F.when(
            contains_any(c, ("http", "@", "#")),
            F.regexp_replace(c, rf"(?U)(?=[h@#])(?:http{NOT_SPACE}+|@{WORD}+|#{WORD}+)", ""),
        ).otherwise(c)

    return squeeze(let(let(text_or_empty(column), drop_emoji), drop_links))


@remembered
def fold(column: Column) -> Column:
    """Lower case without accents.  One-to-many decompositions (ligatures,
    fractions) keep their character."""
    def plain(lowered: Column) -> Column:
        # as many bytes as characters: pure ASCII, nothing to translate
        return F.when(F.length(lowered) == F.octet_length(lowered), lowered).otherwise(
            F.translate(lowered, _FOLD_FROM, _FOLD_TO)
        )

    return let(F.lower(column), plain)


def tokens(column: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def needles(terms: Iterable[str]) -> list[str]:
    """Terms without those that already contain another term of the list: the
    shorter one decides, so the longer test can never change the answer."""
    unique = list(dict.fromkeys(terms))
    return [t for t in unique if not any(o != t and o in t for o in unique)]


def string_array(values: Iterable[str]) -> Column:
    """A constant ``array<string>`` (one literal, split while planning)."""
    items = list(values)
    if not items:
        return F.array().cast("array<string>")
    return F.split(F.lit(_UNIT.join(items)), _UNIT)


def contains_any(column: Column, terms: Iterable[str]) -> Column:
    """Any term is a substring.  Byte searches in turn, stopping at the first hit:
    measured faster than one alternation regex."""
    terms = needles(terms)
    if not terms:
        return F.lit(False)
    if len(terms) <= 3:
        tests = [F.contains(column, F.lit(term)) for term in terms]
        return reduce(lambda a, b: a | b, tests)
    return let(
        column,
        lambda c: F.exists(string_array(terms), lambda term: F.contains(c, term)),
    )


#: White space (as SPACE) and what bounds a token, for the patterns of ``hits``.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def any_substring(terms: Iterable[str], *, loose: bool = False) -> str:
    """Pattern: any term is a substring (``loose``: a blank in a term is any white space)."""
    found = "|".join(re.escape(t) for t in needles(terms))
    return found.replace(r"\ ", _BLANKS) if loose else found


def any_token(terms: Iterable[str], characters: str) -> str:
    """Pattern: any term is a whole token, a run of ``characters``; other terms are none."""
    whole = [re.escape(t) for t in terms if re.fullmatch(f"[{characters}]+", t)]
    return rf"(?:\A|[^{characters}])(?:{'|'.join(whole)})(?:[^{characters}]|\z)" if whole else ""


def hits(column: Column, patterns: Sequence[str]) -> Column:
    """``array<int>``: which of the patterns (from 0, rising; '' matches nothing) a text matches.

    A batch is searched for one alternation after the other by an automaton that reads each
    character once, however many terms the pattern has; a null text gives null.
    """
    wanted = list(patterns)

    @F.arrow_udf("array<int>")
    def search(texts: pa.Array) -> pa.Array:
        matched = np.zeros((len(texts), len(wanted)), bool)
        for i, pattern in enumerate(wanted):
            if pattern:
                own = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
                matched[:, i] = own.to_numpy(zero_copy_only=False)
        row, number = np.nonzero(matched)
        starts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(number.astype(np.int32)), mask=mask)

    return search(column)


def constant_map(table: Mapping[str, str | Sequence[str]]) -> Column:
    """A constant map from string to string, or to array of strings."""
    kind = "string" if all(isinstance(v, str) for v in table.values()) else "array<string>"
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def phrase_key(column: Column) -> Column:
    """A term or text as folded tokens joined by single blanks, so that a phrase
    match is a match of whole tokens."""
    return F.array_join(tokens(fold(column), "[a-z0-9$]+"), " ")


def round4(column: Column) -> Column:
    """Four decimals, ties to even (what a binary-float ``round`` does)."""
    return F.bround(column, 4)
