"""Source mixing and URL rules against plain versions."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postpulse.llm.source_mix import mix, seats, source_targets
from postpulse.llm.url_filter import judge_urls, rules_table


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Reshares the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        shares = sum(weight[s] for s in open_)
        target = {s: float(most * sizes[s]) for s in fixed} | {s: left * weight[s] / shares for s in open_}
        above = [s for s in open_ if target[s] > most * sizes[s] + 1e-9]
        if not above:
            return target
        fixed |= set(above)


def test_targets_equal_the_repeated_resharing(spark):
    rng = random.Random(1)
    for trial in range(6):
        names = [None, "", "a", "B", "é", "zz", "src10", "src9"][: rng.randrange(1, 9)]
        sizes = {n: rng.choice([0, 1, 10, 1000, 100000]) for n in names}
        found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
        want = plain_targets(sizes)
        for r in found.collect():
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9), trial


def test_seats_go_by_highest_quotients(spark):
    rng = random.Random(2)
    rows = [(g, f"p{i}", rng.choice([0, 1, 3, 10, 500, 10_000]), {"x": 0, "y": 3, "z": 977}[g]) for g in "xyz" for i in range(9)]
    df = spark.createDataFrame(rows, "g string, p string, v bigint, total bigint")
    got = {(r["g"], r["p"]): r["seats"] for r in seats(df, "v", "total", ["g"], ["p"], "seats").collect()}
    for g in "xyz":
        own = [r for r in rows if r[0] == g]
        won = dict.fromkeys([r[1] for r in own], 0)
        for _ in range(own[0][3]):
            won[max((r for r in own if r[2]), key=lambda r: (r[2] / (2 * won[r[1]] + 1), [-ord(c) for c in r[1]]))[1]] += 1
        assert {p: n for (h, p), n in got.items() if h == g} == won


def mix_rows():
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 30, 200]))), rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(500)]
    return [*rows, (None, "one two", "a"), (None, None, "a"), (7, "x y z", "b"), (7, "x y z", "b"), (900, "long " * 20_000, "b"), (901, "", "empty")]


@pytest.mark.parametrize("shard_words", [1 << 18, 3000])
def test_mix_meets_targets_and_limits(spark, shard_words):
    df = spark.createDataFrame(mix_rows(), "doc_id bigint, text string, source string").withColumns({"shard": F.lit(1), "size": F.lit("x")})
    rows = mix(df, shard_words=shard_words).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] >= r["size"]
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").split()) for _, t, _ in mix_rows())
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 64 * 2
    again = mix(df.repartition(9), shard_words=shard_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_of_no_rows_and_no_words(spark):
    schema = "doc_id bigint, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()] == [0, 0]


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"), ("block", "b.com", ""), ("allow", "a.b.com", "/d"), ("block", "b.com", "/d"), ("allow", "", ""),
    ("block", "com", "/d"), ("block", "com", "/d"),
]


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(h + p, h, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    rule, _, verdict = min(fits, key=lambda r: (-len(r[0]), -len(r[1]), r[0], r[2]))
    return host, path, rule, verdict


def test_urls_equal_trying_every_rule(spark):
    rng = random.Random(4)
    hosts = ["org", "Example.ORG", "x.example.org", "notexample.org", "com", "a.b.com", "b.com", "zb.com", "c.a.b.com", "", "net.", "é.com", "b.com:80", ".com", "a..com"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12?x", "/en/2#1", "/fr/", "/de/x", "/d", "?/de/", "#/de/", "/d\n/", "/\U0001f600"]
    urls = [None, "", "no scheme", "://", "a://b://c/", *(f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(250))]
    df = spark.createDataFrame([(i if i % 9 else None, u, 1, "x") for i, u in enumerate(urls)], "page_id int, url string, rule int, host string")
    for rules, ranges in ((RULES[:5], 64), (RULES, 7), ([], 4)):
        table = rules_table(spark, rules)
        rows = judge_urls(df, table, ranges=ranges).collect()
        got = sorted((str(r["page_id"]), str(r["url"]), r["judged_host"], r["judged_path"], str(r["judged_rule"]), r["judged_verdict"]) for r in rows)
        want = []
        for i, u in enumerate(urls):
            host, path, rule, verdict = plain_verdict(u, rules)
            want.append((str(i if i % 9 else None), str(u), host, path, str(rule), verdict))
        assert got == sorted(want)
    assert judge_urls(df.limit(0), rules_table(spark, RULES)).count() == 0
