"""Joins and per-key picks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SALT = "_salt"


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread_by: Sequence[str] | None = None,
    salts: int = 8,
) -> DataFrame:
    """Equi-join for a left side with hot (or null) keys.

    Left rows of one key are spread over ``salts`` tasks by a hash of their other
    columns (stable when a task is retried); the narrower right side is repeated
    once per salt.  Spark still broadcasts the right side by itself when its
    measured size allows, so no hint is needed for small lookups.
    """
    basis = spread_by or [c for c in left.columns if c not in on] or list(on)
    salted = left.withColumn(
        _SALT, F.pmod(F.xxhash64(*[F.col(c) for c in basis]), F.lit(salts)).cast("int")
    )
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    # row_number() <= k is planned as a group limit before the shuffle as well,
    # so a hot key sends at most k rows per map task.
    rank = F.row_number().over(Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key (all nulls are one key): the smallest in an explicit order."""
    return _pick(df, keys, [F.col(c).asc_nulls_last() for c in order], 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest in an explicit order."""
    return _pick(df, keys, [F.col(c).desc_nulls_first() for c in order], 1)


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First k rows overall (``TakeOrderedAndProject``) or per group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return _pick(df, by, order, k)
