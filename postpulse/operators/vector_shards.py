"""Exact nearest vectors by cosine, with shards that are skipped by the triangle inequality.

Vectors become unit vectors and are dealt into shards of bounded size whose members are near the
same pivot.  A shard knows its centre and its radius, the largest angle between the centre and a
member.  A query at angle a from the centre is at least a - radius away from every member, so none
of them scores above cos(a - radius).  A task goes through its shards by falling bound and stops
at the first that stays below the query's k-th best score so far.

Pivots are a bounded sample and decide only how tight the shards are, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from postpulse.session import materialize

#: Bytes of vectors in a shard, shards and queries that a task holds at once, and sampled pivots.
SHARD_BYTES, SHARDS_PER_TASK, QUERIES, PIVOTS = 1 << 20, 16, 1024, 256
MARGIN, DIGITS = 1e-9, 12


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def angles(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ to, -1.0, 1.0))


class Search:
    """The best ``k`` of each query over shards (keys ascending, unit vectors, centre, radius)."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = unit(queries), k
        self.best: list[list[tuple[float, object]]] = [[] for _ in queries]
        self.computed = self.possible = 0

    def show(self, shards: list[tuple[list, np.ndarray, np.ndarray, float]]) -> None:
        bounds = np.array([
            np.cos(np.clip(angles(self.queries, centre) - radius - MARGIN, 0.0, np.pi)) for _, _, centre, radius in shards
        ]).reshape(len(shards), len(self.queries))
        self.possible += len(self.queries) * sum(len(s[0]) for s in shards)
        order = np.argsort(-bounds, axis=0, kind="stable")
        for q in range(len(self.queries)):
            for i in order[:, q].tolist():
                if len(self.best[q]) >= self.k and bounds[i, q] < -self.best[q][-1][0] - MARGIN:
                    break
                self._read(q, *shards[i][:2])

    def _read(self, q: int, keys: list, vectors: np.ndarray) -> None:
        scores = np.round(vectors @ self.queries[q], DIGITS)
        self.computed += len(keys)
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            found = np.flatnonzero(scores >= edge)
        else:
            found = np.arange(len(scores))
        top = found[np.argsort(-scores[found], kind="stable")[: self.k]]  # keys ascend: ties in order
        own = self.best[q] + [(-float(scores[i]), keys[i]) for i in top.tolist()]
        own.sort()
        self.best[q] = own[: self.k]


def write_shards(vectors: DataFrame) -> DataFrame:
    """(keys, vectors, centre, radius) of ``vectors(key, v)``, ``v`` an array of doubles."""
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).collect()
    pivots = unit(np.array([r["v"] for r in sample], np.float64)) if sample else np.zeros((0, 0))
    key_kind = vectors.schema["key"].dataType

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (unit(matrix(batch.column("v"))) @ pivots.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *batch.columns], names=["cell", "key", "v"])

    celled = vectors.mapInArrow(near, StructType([StructField("cell", IntegerType()), *vectors.schema.fields]))
    schema = StructType([
        StructField("keys", ArrayType(key_kind)), StructField("vectors", BinaryType()),
        StructField("centre", ArrayType(DoubleType())), StructField("radius", DoubleType()),
    ])

    def packed(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("key")
        data = unit(matrix(rows.column("v").combine_chunks()))
        centre = unit(data.sum(0, keepdims=True))[0]
        return pa.RecordBatch.from_arrays([
            pa.array([rows.column("key").to_pylist()], pa.list_(rows.schema.field("key").type)), pa.array([data.tobytes()], pa.binary()),
            pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(angles(data, centre).max())]),
        ], names=["keys", "vectors", "centre", "radius"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            width = 8 * max(1, len(batch.column("v")[0])) if batch.num_rows else 8
            most = max(1, SHARD_BYTES // width)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                for at in range(low, high, most):
                    part = batch.slice(at, min(most, high - at))
                    held = sum(w.num_rows for w in waiting)
                    # a shard ends with its cell, but small cells that stand side by side share one
                    if held and (held + part.num_rows > most or (held >= most // 8 and part.column("cell")[0] != waiting[-1].column("cell")[0])):
                        yield packed(pa.Table.from_batches(waiting))
                        waiting = []
                    waiting.append(part)
        if waiting:
            yield packed(pa.Table.from_batches(waiting))

    ordered = celled.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")
    return materialize(ordered.mapInArrow(gather, schema), "vector-shards")


def nearest(shards: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(query, key, score): the best ``k`` of each of ``queries(query, q)`` in each task's shards.
    Queries are dealt into blocks of about ``block``; shards are read once for each block."""
    block = block or QUERIES
    numbered = shards.withColumn("shard", F.xxhash64("vectors", F.to_json(F.struct("keys"))))
    tasks, blocks = max(1, -(-shards.count() // SHARDS_PER_TASK)), max(1, -(-queries.count() // block))
    left = numbered.withColumns({
        "_t": F.pmod("shard", F.lit(tasks)).cast("int"), "_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    })
    right = queries.withColumns({
        "_b": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"), "_t": F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))),
    })
    schema = StructType([
        StructField("query", queries.schema["query"].dataType),
        StructField("key", shards.schema["keys"].dataType.elementType), StructField("score", DoubleType()),
    ])

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if asked.num_rows and own.num_rows:
            run = Search(matrix(asked.column("q").combine_chunks()), k)
            held = []
            for i in range(own.num_rows):
                keys = own.column("keys")[i].as_py()
                data = np.frombuffer(own.column("vectors")[i].as_buffer(), np.float64).reshape(len(keys), -1)
                held.append((keys, data, np.array(own.column("centre")[i].as_py()), own.column("radius")[i].as_py()))
            run.show(held)
            names = asked.column("query").to_pylist()
            rows = [(names[q], key, -score) for q, best in enumerate(run.best) for score, key in best]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = (asked.schema.field("query").type, own.schema.field("keys").type.value_type, pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "key", "score"])

    return left.groupBy("_t", "_b").cogroup(right.groupBy("_t", "_b")).applyInArrow(search, schema)
