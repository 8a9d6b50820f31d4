"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Three stages, each of which groups by digest *and* full content: within a task (Spark's
map-side aggregate), within a salt of the digest, and over the salts.  A text that fills a
third of all rows leaves each task as one row and reaches the last stage as ``SALTS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import ascii_lower, attach, columns_of
from postpulse.session import materialize

SALTS = 8


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _winners(rows: DataFrame) -> DataFrame:
    """One row per distinct content: its largest id and its number of rows."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return (
        merged.repartition("digest").groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    * Equal: same text after lower-casing A-Z; a null text counts as empty.
    * The row with the largest id stays.  A null id is smaller than any other; in a group
      of null ids only, keep_id is null and every row is kept, as none can be named.
    * Repeated rows (same id, same text) count in group_size and share one verdict.
    * Empty table: no rows.  Other columns, whatever their names, are not looked at.
    * ``digest`` only routes.  If two contents share a digest, the documents concerned are
      matched by full content.
    """
    rows = columns_of(docs, id=id_col, content=text_col).withColumn(
        "content", ascii_lower(F.coalesce("content", F.lit("")))
    )
    rows = rows.withColumn("digest", digest(F.col("content")))
    by_digest = _winners(rows).groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")
    )
    groups = materialize(by_digest, "exact-groups")
    narrow = rows.select("id", "digest", F.sha2("content", 256).alias("text_sha256"))
    single = groups.where("contents = 1").select(
        "digest", "keep_id", F.col("n").alias("group_size"), F.col("n").alias("weight"),
    )
    shared = groups.where("contents > 1").select("digest")
    if shared.isEmpty():
        found = attach(narrow, single, "digest", "weight")
    else:  # two contents, one digest: the digest says nothing, the content decides
        found = attach(
            narrow.join(shared, "digest", "left_anti"), single, "digest", "weight"
        )
        mixed = rows.join(shared, "digest", "left_semi")
        classes = _winners(mixed).select(
            "content", F.col("keep_id"), F.col("n").alias("group_size")
        )
        matched = mixed.join(classes, "content").select(
            "id", "digest", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size"
        )
        found = found.unionByName(matched)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_row: bool = False) -> DataFrame:
    """``docs`` without the rows that exact_groups drops, found again by id and content.  With
    ``one_row`` also of kept rows with one id (or none) and one content only one stays."""
    found = exact_groups(docs, id_col, text_col)
    gone = found.where("not kept").select(
        F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")
    ).distinct()
    content = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    same = docs[id_col].eqNullSafe(gone["_gone_id"]) & (content == gone["_gone_text"])
    left = docs.join(gone, same, "left_anti")
    if not one_row:
        return left
    again = materialize(
        found.where("kept").groupBy(F.col("doc_id").alias("_again_id"), F.col("text_sha256").alias("_again_text"))
        .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "exact-again",
    )
    if again.isEmpty():
        return left
    keyed = left.withColumns({"_key": F.col(id_col), "_content": F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)})
    equal = F.expr("_key <=> _again_id and _content = _again_text")
    one = keyed.join(again, equal, "left_semi").dropDuplicates(["_key", "_content"])
    return keyed.join(again, equal, "left_anti").unionByName(one).drop("_key", "_content")
