"""Fill-in-the-middle rewriting of texts by counted regular expressions.

A text is a run of units (code points by default).  ``regexp_count`` counts them; two hashes of
a row's id choose where the middle begins and ends; a pattern made for that row,
``(unit{a}+)(unit{b-a}+)(rest)``, captures prefix, middle and suffix in one match, whose
replacement string puts them in the order of the row's form.  The quantifiers are possessive:
they never give back, so a match runs once over the text and needs no stack.

All is done row by row in the JVM: nothing is shuffled, and a row holds its text, its output
and what is rebuilt from it.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel
already, is ``plain`` (unchanged, no lengths); a null id is hashed as the seed alone; equal rows
get equal results; an empty table gives no rows; every column of the input stays under its
name, and a new column whose name is taken gets a number.
"""

from __future__ import annotations

import re
from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line ends included.
CODE_POINT = "(?s:.)"
#: Before the prefix, before the suffix, before the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units that regexp_count takes as one, so that it holds few matches of a long text.
COUNTED = 4096


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """Number of units; blocks of COUNTED are counted first, then what they leave."""
    block = f"(?:{unit}){{{COUNTED}}}+"
    left = F.regexp_replace(text, block, "")
    return (F.regexp_count(text, F.lit(block)) * COUNTED + F.regexp_count(left, F.lit(f"(?:{unit})"))).cast("bigint")


def _quoted(value: str) -> str:
    """A replacement string that stands for itself."""
    return value.replace("\\", "\\\\").replace("$", "\\$")


def _check(sentinels: tuple[str, str, str]) -> None:
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError("sentinels must be non-empty, and none may begin within another or itself")


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1, plain_percent: int = 10,
    spm_percent: int = 20, unit: str = CODE_POINT, sentinels: tuple[str, str, str] = SENTINELS,
) -> tuple[DataFrame, list[str]]:
    """``df`` with units n, form, prefix and middle lengths, and output; names used are returned.

    ``unit``: a pattern whose matches cover any text from left to right without gaps.  Of the
    rows, ``plain_percent`` stay as they are; of the others ``spm_percent`` have the suffix first.
    """
    _check(sentinels)
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        found = next(n for n in chain([name], (f"{name}_{i}" for i in count(2))) if n.lower() not in taken)
        taken.add(found.lower())
        return found

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    n, form, before, middle, output = (free(x) for x in ("n", "form", "prefix_chars", "middle_chars", "output"))
    h, low, high = free("_h"), free("_low"), free("_high")

    def hashed(i: int) -> Column:
        return F.conv(F.substring(F.col(h), 8 * i + 1, 8), 16, 10).cast("bigint")

    is_plain = (text == "") | (hashed(2) % 100 >= 100 - plain_percent)
    for s in sentinels:
        is_plain = is_plain | F.contains(text, F.lit(s))
    p, s, m = map(_quoted, sentinels)
    pattern = F.concat(
        F.lit(f"\\A((?:{unit}){{"), F.col(low).cast("string"), F.lit(f"}}+)((?:{unit}){{"),
        (F.col(high) - F.col(low)).cast("string"), F.lit("}+)((?s:.*+))\\z"),
    )
    order = F.when(F.col(form) == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    shaped = (
        df.withColumns({h: digest, n: count_units(text, unit)})
        .withColumns({f"{low}1": hashed(0) % (F.col(n) + 1), f"{high}1": hashed(1) % (F.col(n) + 1)})
        .withColumns({
            low: F.least(f"{low}1", f"{high}1"), high: F.greatest(f"{low}1", f"{high}1"),
            form: F.when(is_plain, "plain").when(hashed(3) % 100 < spm_percent, "spm").otherwise("psm"),
        })
    )
    cut = F.col(form) != "plain"
    return shaped.select(
        *[F.col(f"`{c}`") for c in df.columns], n, form, F.when(cut, F.col(low)).alias(before),
        F.when(cut, F.col(high) - F.col(low)).alias(middle),
        F.when(cut, F.regexp_replace(text, pattern, order)).otherwise(text).alias(output),
    ), [n, form, before, middle, output]


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of.  No sentinel lies within a text that was cut."""
    p, s, m = (re.escape(x) for x in sentinels)
    psm = F.regexp_replace(output, F.lit(f"\\A{p}((?s:.*?)){s}((?s:.*?)){m}((?s:.*+))\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"\\A{s}((?s:.*?)){p}((?s:.*?)){m}((?s:.*+))\\z"), F.lit("$2$3$1"))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
