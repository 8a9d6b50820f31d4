"""Nearest vectors with skipped shards against a scan."""

import numpy as np
import pytest

from postpulse.operators import vector_shards
from postpulse.operators.retrieval import vector_search
from postpulse.operators.vector_shards import Search, angles, unit


def scanned(keys, data, query, k):
    scores = np.round(unit(data) @ unit(query[None])[0], 12)
    return sorted(zip((-scores).tolist(), keys))[:k]


def clustered(rng, n, d, centres):
    return rng.normal(size=(centres, d))[np.sort(rng.integers(0, centres, n))] + rng.normal(0, 0.05, (n, d))


def as_shards(keys, data, size):
    out = []
    for low in range(0, len(keys), size):
        part = unit(data[low : low + size])
        centre = unit(part.sum(0, keepdims=True))[0]
        out.append((keys[low : low + size], part, centre, float(angles(part, centre).max())))
    return out


@pytest.mark.parametrize("k", [1, 7, 400])
def test_skipping_changes_nothing(k):
    rng = np.random.default_rng(k)
    data = np.vstack([clustered(rng, 900, 6, 30), np.zeros((3, 6)), np.ones((20, 6))])
    keys = list(range(len(data)))
    queries = np.vstack([data[::90], rng.normal(size=(10, 6)), np.zeros((1, 6)), -data[:1]])
    run = Search(queries, k)
    run.show(as_shards(keys, data, 10))
    for q, best in zip(queries, run.best):
        assert best == scanned(keys, data, q, k)
    if k == 1:
        assert run.computed < 0.5 * run.possible  # most shards are never read


def test_tables_equal_scan_in_any_block_size(spark, monkeypatch):
    monkeypatch.setattr(vector_shards, "SHARD_BYTES", 3000)
    monkeypatch.setattr(vector_shards, "SHARDS_PER_TASK", 3)
    monkeypatch.setattr(vector_shards, "QUERIES", 4)
    rng = np.random.default_rng(9)
    data = clustered(rng, 600, 5, 12)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(9999, None)], "vec_id int, embedding array<double>").repartition(5)
    asked = {i: rng.normal(size=5) for i in range(11)}
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in asked.items()] + [(50, None)], "query_id int, query array<double>")
    rows = vector_search(vectors, queries, k=6).collect()
    assert len(rows) == 66
    for i, q in asked.items():
        got = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == i)
        assert [v for _, v in got] == [key for _, key in scanned(list(range(600)), data, q, 6)]
    assert vector_search(vectors.limit(0), queries, k=2).collect() == []
    assert vector_search(vectors, queries.limit(0), k=2).collect() == []
