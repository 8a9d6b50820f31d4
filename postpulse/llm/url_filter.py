"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) becomes the key ``reversed host + SEPARATOR + path`` and matches the
interval of keys that begin with it.  A url has one key per suffix of its host, so that a
rule on a parent domain meets the url's path as well.  Keys and rules are dealt by key range,
sorted, and swept once: the rules whose interval is open form a stack, because intervals of
prefixes either nest or are disjoint.  A rule goes to each range its interval reaches, which
is at most (rules + ranges x longest nest) rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import ascii_lower, attach
from postpulse.session import materialize

#: Sorts below every character that a label or a path can hold.
SEPARATOR = "\x00"
#: Keys drawn to choose range borders; only the balance of the ranges depends on them.
BORDER_SAMPLE = 2_000
RANGES = 64

RULES = "rule string, host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table; a rule is shown as host + path."""
    return spark.createDataFrame([(h + p, h, p, v) for v, h, p in rules], RULES)


def _suffix_keys(host: Column, path: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(SEPARATOR), path),
    )


def _borders(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ``ranges - 1`` (key, salt) borders from at most BORDER_SAMPLE keys."""
    drawn = sorted(
        (r["key"], r["salt"]) for r in
        keys.orderBy(F.xxhash64("url_id", "key")).limit(BORDER_SAMPLE).select("key", "salt").collect()
    )
    step = max(1, len(drawn) // ranges)
    return sorted(set(drawn[step::step]))[: ranges - 1]


def _to_ranges(rows: DataFrame, rules: DataFrame, borders: list[tuple[str, int]]) -> DataFrame:
    """Urls with their range, and rules once for each range they reach, sorted for the sweep."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, salt, url_id, rule in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if url_id is not None:
                    out.append((bisect_right(borders, (key, salt)), key, 1, url_id, None))
                    continue
                first = bisect_right(borders, (key, -1))
                last = bisect_right(borders, (key + "\U0010ffff", 1 << 40))
                out.extend((n, key, 0, None, rule) for n in range(first, last + 1))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)],
                names=["range", "key", "kind", "url_id", "rule"],
            )

    both = rows.select("key", "salt", "url_id", F.lit(None).cast("string").alias("rule")).unionByName(
        rules.select("key", F.lit(-1).alias("salt"), F.lit(None).cast("string").alias("url_id"), "rule")
    )
    return both.mapInArrow(place, "range int, key string, kind int, url_id string, rule string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in key order, rules first: the innermost open rule of each url key."""
    current, stack = None, []
    for batch in batches:
        ids: list[str] = []
        rules: list[str] = []
        for number, key, kind, url_id, rule in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if number != current:
                current, stack = number, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule))
            elif stack:
                ids.append(url_id)
                rules.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rules, pa.string())], names=["url_id", "rule"])


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", ranges: int = RANGES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict under the names ``judged_*``.

    * A null url or one without ``://`` has an empty host and path; no rule fits it.
    * A rule fits its host and all subdomains if the path starts with the rule's path.  The
      longest rule (host + path, in characters) wins, then the longer host, then the first by
      code point.  Equal (host, path) rules: the smallest verdict, so ``allow`` before ``block``.
    * No rule: rule is null and the verdict is ``default``.
    * Equal urls are judged once and joined back to all their rows; every row of ``pages`` comes
      back, with all its columns.  Empty pages or rules are fine.
    """
    judged = pages.withColumns({
        "judged_host": url_host(F.col(url_col)), "judged_path": url_path(F.col(url_col)),
    })
    judged = judged.withColumn("judged_id", F.concat("judged_host", F.lit("\n"), "judged_path"))
    urls = materialize(
        judged.groupBy("judged_id", "judged_host", "judged_path").agg(F.count(F.lit(1)).alias("rows")), "urls"
    )
    distinct = rules.groupBy("rule", "host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = distinct.withColumn("key", F.concat(
        F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(SEPARATOR), "path"
    ))
    info = F.to_json(F.struct(
        F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "verdict",
    ))
    rows = urls.select(
        F.col("judged_id").alias("url_id"), F.explode(_suffix_keys(F.col("judged_host"), F.col("judged_path"))).alias("key"),
    ).withColumn("salt", F.pmod(F.xxhash64("url_id"), F.lit(1 << 20)))
    placed = _to_ranges(rows, keyed.select("key", info.alias("rule")), _borders(rows, ranges))
    found = (
        placed.repartition("range").sortWithinPartitions("range", "key", "kind")
        .mapInArrow(_sweep, "url_id string, rule string")
        .withColumn("r", F.from_json("rule", "size int, host_size int, rule string, verdict string"))
    )
    best = found.groupBy("url_id").agg(F.min_by("r", F.struct(
        -F.col("r.size"), -F.col("r.host_size"), F.col("r.rule")
    )).alias("r"))
    answers = materialize(
        urls.join(best, urls["judged_id"] == best["url_id"], "left")
        .select("judged_id", "rows", F.col("r.rule").alias("judged_rule"), F.coalesce("r.verdict", F.lit(default)).alias("judged_verdict")),
        "url-verdicts",
    )
    return attach(judged, answers, "judged_id", "rows").drop("judged_id")
