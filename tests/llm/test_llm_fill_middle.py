"""Fill-in-the-middle against plain string slicing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postpulse.llm import fill_middle
from postpulse.llm.fill_middle import count_units, fill_in_middle, restore

CASES = [
    (1, "plain words in a row"), (2, ""), (3, None), (None, "no id"), (5, "é🤦🏼‍♂️ a\r\nb\n\x00c"), (6, "has <S> inside"),
    (7, "$1 \\ {2} (?:x) <S <P M>"), (8, "x"), (8, "x"), (9, "<" * 50), (10, "long 🤦 text\n" * 40_000),
    *[(i, f"row {i} of many, ü") for i in range(100, 400)],
]


def sliced(doc_id, text, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    form = "spm" if h[3] % 100 < 20 else "psm"
    first, mid, last = t[:a], t[a:b], t[b:]
    out = f"<P>{first}<S>{last}<M>{mid}" if form == "psm" else f"<S>{last}<P>{first}<M>{mid}"
    return len(t), form, a, b - a, out


def test_equals_slicing_and_comes_back(spark):
    df = spark.createDataFrame(CASES, "doc_id bigint, text string")
    cut, (n, form, before, middle, output) = fill_in_middle(df)
    rows = cut.withColumn("back", restore(F.col(output), F.col(form))).collect()
    assert {r[form] for r in rows} == {"plain", "psm", "spm"}
    got = sorted(((r["doc_id"], r["text"], r[n], r[form], r[before], r[middle], r[output]) for r in rows), key=repr)
    assert got == sorted(((d, t, *sliced(d, t)) for d, t in CASES), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in rows)


def test_clashing_names_other_seed_and_no_rows(spark):
    df = spark.createDataFrame([(4, "abc def", 1, "keep", 2)], "doc_id int, text string, n int, FORM string, _low int")
    cut, names = fill_in_middle(df, seed=7)
    assert cut.columns[:5] == df.columns and names[:2] == ["n_2", "form_2"]
    row = cut.collect()[0]
    assert (row["n"], row["FORM"], row["_low"]) == (1, "keep", 2)
    assert (row["n_2"], row["form_2"], row[names[4]]) == tuple(sliced(4, "abc def", 7)[i] for i in (0, 1, 4))
    assert fill_in_middle(df.limit(0))[0].collect() == []


def test_units_of_words(spark):
    df = spark.createDataFrame([(i, "one two  three four five ") for i in range(20)], "doc_id int, text string")
    cut, (n, form, before, middle, output) = fill_in_middle(df, unit=r"\S*\s+")
    for r in cut.withColumn("back", restore(F.col(output), F.col(form))).collect():
        assert r[n] == 5 and r["back"] == r["text"]


def test_counting_in_blocks(spark):
    sizes = [0, 1, fill_middle.COUNTED - 1, fill_middle.COUNTED, 3 * fill_middle.COUNTED + 1]
    df = spark.createDataFrame([("🤦" * k,) for k in sizes], "t string")
    assert [r[0] for r in df.select(count_units(F.col("t"))).collect()] == sizes


def test_sentinels_that_could_be_mistaken(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    for bad in (("", "b", "c"), ("<P>", "<P>x", "c"), ("aa", "b", "c"), ("<P", "P>", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(df, sentinels=bad)
