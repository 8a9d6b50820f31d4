"""Column helpers and the skew-safe join shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A key is hot when it holds more than one row in so many; there are at most so many hot keys.
HOT_SHARE = 1000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns under inner names, so that other columns can have any name."""
    return df.select(*[df[source].alias(inner) for inner, source in wanted.items()])


def attach(rows: DataFrame, classes: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``classes`` (one row per ``key``, written before).

    ``weight`` is the number of rows a key has.  Keys with more than one row in
    ``HOT_SHARE`` are at most ``HOT_SHARE`` keys whatever the size of the input, so their
    classes are broadcast; the other keys are spread well and meet in a shuffle join.
    """
    total = F.broadcast(classes.agg(F.sum(weight).alias("_total")))
    sized = classes.join(total, F.lit(True)).withColumn("_hot", F.col(weight) * HOT_SHARE > F.col("_total"))
    hot = sized.where("_hot").drop("_total", "_hot", weight).withColumn("_is_hot", F.lit(True))
    cold = sized.where("not _hot").drop("_total", "_hot", weight)
    values = [c for c in classes.columns if c not in (key, weight)]
    marked = rows.join(F.broadcast(hot), key, "left")
    in_hot = marked.where(F.col("_is_hot").isNotNull()).select(*rows.columns, *values)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return in_hot.unionByName(others.select(*rows.columns, *values))


#: Bits of the map that maybe_in sends to all tasks: 1 MB, whatever the number of keys.
MAP_BITS = 1 << 23


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``, before a shuffle.

    The keys set bits in a map of MAP_BITS bits, of which at most MAP_BITS / 64 words are
    broadcast.  The map errs by letting rows through, and with very many keys lets all
    through; the join that follows decides.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    words = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")
    )
    return (
        rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
        .join(F.broadcast(words), "_word")
        .where(F.expr("(shiftrightunsigned(_bits, cast(_bit % 64 as int)) & 1) = 1"))
        .select(*rows.columns)
    )


#: Bytes of output that a batch of map_rows gathers before it is handed on.
OUT_BYTES = 1 << 24


def map_batches(
    df: DataFrame, text_col: str, run: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, str]],
) -> tuple[DataFrame, list[str]]:
    """``df`` with columns computed from one text column in Arrow batches.

    ``fields``: (name, Spark type).  A name that ``df`` has already gets a number, so no
    column of ``df`` is lost; the names used are returned.  Batches are cut where their
    texts exceed OUT_BYTES.
    """
    names: list[str] = []
    taken = {c.lower() for c in df.columns}
    for name, _ in fields:
        free = next(n for n in chain([name], (f"{name}_{i}" for i in count(2))) if n.lower() not in taken)
        taken.add(free.lower())
        names.append(free)
    at, n_new = df.columns.index(text_col), len(fields)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            cuts = [0, *(np.flatnonzero(np.diff(sizes // OUT_BYTES)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *run(part.column(at))],
                    names=[*(f"c{i}" for i in range(part.num_columns)), *(f"n{i}" for i in range(n_new))],
                )

    added = StructType.fromDDL(", ".join(f"n{i} {kind}" for i, (_, kind) in enumerate(fields)))
    inner = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)), *added.fields])
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.mapInArrow(whole, inner).toDF(*df.columns, *names), names


def map_rows(
    df: DataFrame, text_col: str, run: Callable[[pa.Array], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]],
) -> tuple[DataFrame, list[str]]:
    """map_batches() for a function that yields one tuple per text; fields also name the
    Arrow types."""
    kinds = [k for _, _, k in fields]

    def columns(texts: pa.Array) -> list[pa.Array]:
        rows = list(run(texts))
        found = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        return [pa.array(c, k) for c, k in zip(found, kinds, strict=True)]

    return map_batches(df, text_col, columns, [(name, kind) for name, kind, _ in fields])


def mark_maybe(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false where ``key`` is surely not in ``keys`` (see maybe_in)."""
    bit = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    words = keys.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")
    )
    sure = F.expr("(shiftrightunsigned(coalesce(_bits, 0L), cast(_bit % 64 as int)) & 1) = 1")
    return (
        rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
        .join(F.broadcast(words), "_word", "left").select(*rows.columns, sure.alias(name))
    )
