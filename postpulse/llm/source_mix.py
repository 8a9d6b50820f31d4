"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of ``BLOCK`` words.  The blocks go to the sources by highest
quotients ``target / (2 s + 1)``, then each source's blocks to its shards in the same way,
which gives every shard an integer quota.  Inside a shard the documents stand in a seeded
order; a quota is whole passes over the shard plus one run of blocks from a seeded start.

Only counts leave the map side: one row per shard (about ``SHARD_WORDS`` words), then one
per source.  A hot source has many shards, so no task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import columns_of
from postpulse.session import materialize

#: Words of a block, and words that a shard should hold.
BLOCK = 64
SHARD_WORDS = 1 << 18
#: No source and no document is taken more often than this.
MOST_PASSES = 3
#: Weights by rank of the source's name, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def seats(parties: DataFrame, votes: str, total: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """``parties`` with ``name``: its seats out of ``total`` by highest quotients votes/(2s+1).

    ``total`` is a column that is the same for all parties of a ``by`` group.  With n parties
    the divisor sum/(total - n/2) never gives too many seats and sum/(total + n/2) never too
    few, so only the quotients between the two bounds (about n + total's remainder) are
    ranked; ties go by ``order``.  Zero votes: no seat.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    bounded = (
        parties
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sum", F.sum(votes).over(group))
        .withColumn("_share", F.when(F.col("_sum") > 0, F.col(votes) / F.col("_sum")).otherwise(F.lit(0.0)))
        .withColumn("_low", F.floor(F.greatest(
            F.lit(0.0), F.col("_share") * (F.col(total) - F.col("_n") / 2) + F.lit(0.5) - F.lit(1e-6)
        )).cast("bigint"))
        .withColumn("_high", F.when(F.col(votes) > 0, F.floor(
            F.col("_share") * (F.col(total) + F.col("_n") / 2) + F.lit(0.5) + F.lit(1e-6)
        ).cast("bigint") + 1).otherwise(F.lit(0).cast("bigint")))
        .withColumn("_left", F.col(total) - F.sum("_low").over(group))
    )
    quotients = (
        bounded.where("_high > _low")
        .withColumn("_s", F.explode(F.sequence("_low", F.col("_high") - 1)))
        .withColumn("_q", F.col(votes) / (2 * F.col("_s") + 1))
    )
    ranked = quotients.withColumn("_rank", F.row_number().over(
        group.orderBy(F.desc("_q"), *[F.asc_nulls_last(c) for c in order], "_s")
    ))
    key = [*by, *order]
    extra = (
        ranked.groupBy(*key)
        .agg(F.sum((F.col("_rank") <= F.col("_left")).cast("bigint")).alias("_extra"))
        .select(*[F.col(c).alias(f"_k_{c}") for c in key], "_extra")
    )
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return bounded.join(extra, same, "left").select(
        *parties.columns, (F.col("_low") + F.coalesce("_extra", F.lit(0))).alias(name)
    )


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: their share by weight of all words,
    at most ``most`` times their size, the excess reshared by weight until none is above.

    That fixed point fills the sources in the order of size / weight: with the sources up to
    some rank at their limit, the others share the rest by weight.  The level falls once a
    source is counted as full that is not, so the largest level that fits is the fixed point.
    """
    alone = Window.partitionBy(F.lit(0))
    order = alone.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )).withColumn("_limit", (F.col("source_size") * most).cast("double"))
    by_level = alone.orderBy(F.col("_limit") / F.col("_w"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    return (
        ranked
        .withColumn("_all", F.sum("source_size").over(alone))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_limit"))
        .withColumn("_open", F.max(F.when(F.col("_free"), F.col("_level"))).over(alone))
        .withColumn("target", F.when(
            F.col("_open").isNotNull(), F.least("_limit", F.col("_open") * F.col("_w"))
        ).otherwise(F.col("_limit")))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK,
    shard_words: int = SHARD_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    * size: words (runs of anything but ASCII white space); a null or empty text has 0 and is
      never taken.  A null source is a source of its own, the last in order; a null id counts
      as the text ``null`` in the seeded order.
    * taken is at most ``most`` times size.  Rows equal in id and size share one place in the
      seeded order as a set: which of them takes what is open, their sum is not.
    * The same rows give the same result, whatever their order or partitions.
    * Empty table: no rows.  Other columns are not looked at.
    """
    sized = materialize(
        columns_of(docs, id=id_col, source=source_col, text=text_col)
        .select("id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    blocks = Window.partitionBy(F.lit(0))
    shared = seats(
        totals.withColumn("_blocks", F.floor(F.sum("source_size").over(blocks) / block + F.lit(0.5)).cast("bigint")),
        "target", "_blocks", [], ["source"], "blocks",
    )
    plan = materialize(shared.select(
        "source", "source_size", "target", "blocks",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint").alias("shards"),
    ), "mix-sources")

    # a source has few rows here (one), so the hot source's rows meet it without a shuffle of texts
    place = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    named = sized.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    p = plan.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    placed = (
        named.join(p, "_name")
        .withColumn("place", place)
        .withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint"), F.col("shards")))
    )
    by_shard = placed.groupBy("_name", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks")
    )
    quotas = seats(by_shard, "shard_size", "blocks", ["_name"], ["shard"], "quota").select(
        "_name", "shard", "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * most).alias("quota_words"),
        F.md5(F.concat_ws("|", F.lit(seed), F.lit("start"), "_name", F.col("shard").cast("string"))).alias("_start"),
    )
    line = Window.partitionBy("_name", "shard").orderBy("place", F.asc_nulls_last("id"), "size")
    size, whole = F.col("size"), F.col("shard_size")
    laid = (
        placed.join(quotas, ["_name", "shard"])
        .withColumn("_to", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_to") - size)
        .withColumn("_passes", F.when(whole > 0, F.floor(F.col("quota_words") / whole)).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_rest", F.col("quota_words") - F.col("_passes") * whole)
        .withColumn("_begin", block * F.pmod(
            F.conv(F.substring("_start", 1, 8), 16, 10).cast("bigint"),
            F.greatest(F.lit(1).cast("bigint"), F.ceil(whole / block).cast("bigint")),
        ))
    )
    end = F.col("_begin") + F.col("_rest")  # past the shard's end the run goes on at its start
    inside = F.greatest(F.lit(0), F.least("_to", end) - F.greatest("_from", "_begin"))
    wrapped = F.greatest(F.lit(0), F.least(F.col("_to"), end - whole) - F.col("_from"))
    return laid.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("_passes") * size + inside + wrapped).cast("bigint").alias("taken"),
    )
