"""Product codes against a scan of all entries in plain integers."""

import math

import numpy as np
import pytest

from postpulse.llm import vector_codes
from postpulse.llm.vector_codes import anchors, assign, build_tree, encode_vectors, with_label_error


def scanned(vectors, entries, rounds, parts, scale=1024):
    """Codes, errors and books of lists of floats, in Python's integers."""
    whole = [[math.floor(scale * x) for x in v] for v in vectors]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in whole] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    best = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    codes = ["".join(f"{best[p][i][1]:02x}" for p in range(parts)) for i in range(len(whole))]
    return codes, [sum(best[p][i][0] for p in range(parts)) for i in range(len(whole))], books


def random_values(rng, n, d, clusters):
    return (rng.integers(-400, 400, (clusters, d))[rng.integers(0, clusters, n)] + rng.integers(-5, 5, (n, d))).astype(np.int32)


@pytest.mark.parametrize("n, d, clusters", [(1, 3, 1), (47, 2, 1), (500, 4, 3), (3000, 16, 20), (800, 1, 800), (300, 8, 1)])
def test_tree_walk_equals_scan(n, d, clusters):
    rng = np.random.default_rng(n)
    values = random_values(rng, n, d, clusters)
    if n == 300:
        values[:] = values[0]  # all rows equal
    tree = build_tree(values)
    assert sorted(tree.order.tolist()) == list(range(n))
    for node in range(len(tree.begin)):
        rows = tree.order[tree.begin[node] : tree.end[node]]
        assert (tree.sums[node] == values[rows].sum(0)).all()
        if tree.left[node] >= 0:
            a, b = int(tree.left[node]), int(tree.right[node])
            assert sorted([(tree.begin[a], tree.end[a]), (tree.begin[b], tree.end[b])]) == [
                (tree.begin[node], min(tree.end[a], tree.end[b])), (max(tree.begin[a], tree.begin[b]), tree.end[node])]
    for book in (values[:256].astype(np.int64), rng.integers(-400, 400, (256, d)), np.zeros((5, d), np.int64)):
        label, sums, counts, computed = assign(vector_codes.Tree.unpack(tree.pack()), values, book)
        far = ((values.astype(np.int64)[:, None] - book[None]) ** 2).sum(2)
        assert (label == far.argmin(1)).all()
        assert (counts == np.bincount(label, minlength=len(book))).all()
        assert all((sums[e] == values[label == e].sum(0)).all() for e in range(len(book)))
        assert computed <= n * len(book)


def test_candidates_shrink_and_balls_are_owned():
    rng = np.random.default_rng(7)
    values = random_values(rng, 4096, 8, 12)
    book = values[:64].astype(np.int64)
    *_, computed = assign(build_tree(values), values, book)
    assert computed < 0.2 * values.shape[0] * len(book)
    _, _, counts, none = assign(build_tree(values), values, values[:1].astype(np.int64))
    assert none == 0 and counts.tolist() == [4096]  # one entry owns the root


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(-vector_codes.BOUND, vector_codes.BOUND, (400, 4)).astype(np.int32)
    book = values[:40].astype(np.int64) + 1
    label, *_ = assign(build_tree(values), values, book)
    far = ((values.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(2)
    assert label.tolist() == [min(range(40), key=lambda j: (f[j], j)) for f in far]


def test_anchors_are_nearest():
    points = np.random.default_rng(2).normal(size=(500, 3))
    owner = anchors(points, 20)
    assert owner.max() == 19 and len(np.unique(owner)) == 20


@pytest.mark.parametrize("block", [16, 4096])
def test_codes_equal_scan(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(x)) for x in rng.normal(0, 0.1, 8)] for _ in range(60)]
    vectors += [vectors[0]] * 40
    rows = [(i, v, i % 3 if i % 5 else None, "x") for i, v in zip(rng.permutation(1000).tolist(), vectors)]
    odd = [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [float("nan")] + [0.0] * 7, 1, "x"), (2003, [None] + [0.0] * 7, 1, "x"),
           (2004, [float("-inf")] + [0.0] * 7, 1, "x"), (2005, [0.0] * 4, 1, "x"), (2006, [0.0] * 9, 1, "x")]
    df = spark.createDataFrame(odd + rows, "vec_id int, embedding array<float>, label int, code string").repartition(3)
    coded, books = encode_vectors(df, keep=("label",), entries=10, rounds=3, parts=2)
    got = with_label_error(coded, "label").collect()
    rows.sort()
    codes, errors, want_books = scanned([r[1] for r in rows], 10, 3, 2)
    assert [b.tolist() for b in books] == want_books
    sums = {}
    for r, e in zip(rows, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [
        (r[0], c, e, sums[r[2]]) for r, c, e in zip(rows, codes, errors)]


def test_few_and_no_vectors_null_ids_and_far_values(spark):
    schema = "vec_id int, embedding array<float>"
    assert encode_vectors(spark.createDataFrame([(1, None)], schema))[0].collect() == []
    df = spark.createDataFrame([(None, [1e30, 0.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.0, 0.0])], schema)
    coded, books = encode_vectors(df)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == [
        (2, "00000000", 0), (2, "00000000", 0), (None, "02000000", 0)]
    assert [len(b) for b in books] == [3] * 4
