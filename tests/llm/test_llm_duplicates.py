"""Exact copies, near copies and repeated strings against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postpulse.llm import suffixes
from postpulse.llm.components import components
from postpulse.llm.exact_dedup import drop_copies, exact_groups
from postpulse.llm.ngram_join import band_of, differing, jaccard_classes, linked, signatures
from postpulse.llm.suffix_dedup import remove_repeats
from postpulse.llm.suffixes import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"
ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "é Same"), (5, "É same"), (6, None), (7, ""),
    (8, "alone"), (8, "alone"), (None, "alone"), (None, "only null"), (None, "only null"), (9, "x" * 70000),
]


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_groups_equal_brute_force_even_if_digests_collide(spark, digest):
    df = spark.createDataFrame(ROWS, DOCS).withColumns({"keep_id": F.lit("x"), "digest": F.lit(1), "n": F.lit(2)})
    found = exact_groups(df, digest=digest) if digest else exact_groups(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_groups(ROWS)


def test_exact_dedup_of_an_empty_table_and_kept_rows(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    kept = drop_copies(spark.createDataFrame(ROWS, DOCS).withColumn("salt", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "salt"]
    assert Counter(r[0] for r in kept.collect()) == Counter([3, 4, 5, 7, 8, 8, None, None, 9])


def words_of(text):
    return WORD.findall(lower(text))


def brute_classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = rows[i][0] == rows[j][0] or 100 * len(a & sets[j]) >= percent * len(a | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and a and sets[j] and same:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(200)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.7:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)] * 2])
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 6, 20, 60, 150]))]
        rows.append((1000 - 3 * i, " ".join(words)))
    return [*rows, (None, rows[5][1]), (None, None), (7, None), (7, rows[9][1]), (7, rows[40][1]), (3, rows[40][1])]


@pytest.mark.parametrize(("k", "percent", "limit"), [(3, 90, 8_000_000), (5, 80, 8_000_000), (2, 70, 1500)])
def test_jaccard_classes_equal_brute_force(spark, k, percent, limit):
    rows = near_rows(k)
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "digest": F.lit(0), "cluster": F.lit(1)})
    found = jaccard_classes(df, words=k, percent=percent, cluster_shingles=limit).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_classes(rows, k, percent)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_sets_share_a_signature_and_a_component():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90, 95):
        for _ in range(150):
            size = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = int(rng.integers(0, differing(2 * len(a), percent) + 1)) // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and len(b):
                assert np.intersect1d(signatures(a, percent), signatures(b, percent)).size
                number = linked([a, b], percent)
                assert number[0] == number[1]


def test_bands_never_skip_a_link():
    for percent in (50, 80, 90):
        for size in range(1, 400):
            band, top = band_of(size, percent)
            assert size <= top
            assert band_of(size * 100 // percent, percent)[0] - band <= 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 7), (500, 500), (None, 3)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(found.values()) == {0}
    assert 500 not in found
    assert len(found) == 41 + 30


@pytest.mark.parametrize("short", [0, 1 << 16])
def test_suffix_array_and_prefixes_equal_sorting(monkeypatch, short):
    monkeypatch.setattr(suffixes, "_SHORT", short)
    rng = random.Random(1)
    for trial in range(150):
        n, k = rng.randrange(1, 90), rng.choice([1, 2, 3, 200])
        t = np.array([rng.randrange(k) for _ in range(n)], np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, n // 7)], 8)
        values = t.tolist()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(values)), key=lambda i, v=values: v[i:])
        prefixes = common_prefixes(t, sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            size = 0
            while max(i, j) + size < len(values) and values[i + size] == values[j + size]:
                size += 1
            assert prefixes[i] == size


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [1 << 19, 1500])
def test_remove_repeats_equals_brute_force(spark, shard_bytes):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(90):
        parts = [
            rng.choice([rng.choice(base)[rng.randrange(100) : rng.randrange(120, 300)], "a" * rng.randrange(80), str(rng.random())])
            for _ in range(rng.randrange(5))
        ]
        rows.append((i if i % 17 else None, "".join(parts) if i % 23 else None))
    rows += rows[:5]
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("x"), "spans": F.lit(1)})
    found = remove_repeats(df, length=40, shard_bytes=shard_bytes).collect()
    got = sorted(((r[0], r[1], [(s["begin"], s["end"]) for s in r[2]], bytes(r[3])) for r in found), key=str)
    assert got == brute_repeats(rows, 40)


def test_remove_repeats_in_one_long_text_and_an_empty_table(spark):
    rng = random.Random(2)
    once = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    text = once + once[500_000:500_600] + "z"
    row = remove_repeats(spark.createDataFrame([(1, text)], DOCS)).collect()[0]
    assert [(s["begin"], s["end"]) for s in row["spans"]] == [(500_000, 500_600), (1_300_000, 1_300_600)]
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def near_copies(n, size=1100, seed=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh ") for _ in range(size)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(size)] = rng.choice("XYZÄ0123456789")
        out.append((i, "".join(rng.choice("klmn") for _ in range(rng.randrange(90))) + "".join(copy)))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 19, 20_000])
def test_near_copies_repeat_across_shards_of_an_anchor(spark, shard_bytes):
    rows = near_copies(120)
    found = remove_repeats(spark.createDataFrame(rows, DOCS), shard_bytes=shard_bytes).collect()
    got = sorted(((r[0], r[1], [(s["begin"], s["end"]) for s in r[2]], bytes(r[3])) for r in found), key=str)
    assert got == brute_repeats(rows, 400)


def test_a_cut_anchor_sends_blocks_and_not_each_window():
    import pyarrow as pa

    from postpulse.llm.suffix_dedup import _judge, segments

    of_anchor: dict = {}
    for _, text in near_copies(200):
        data = np.frombuffer(text.encode(), np.uint8)
        for _, first, count, anchor, digest in zip(*segments(data, np.array([0, len(data)])), strict=True):
            piece = data[first : first + count + 399].tobytes()
            of_anchor.setdefault(int(anchor.view(np.int64)), {})[int(digest.view(np.int64))] = piece
    anchor, pieces = max(of_anchor.items(), key=lambda a: len(a[1]))
    n = len(pieces)
    windows = sum(len(p) - 399 for p in pieces.values())
    group = pa.table({
        "shard": [-5] * n, "cut": [True] * n, "anchor": [anchor] * n, "digest": list(pieces), "n": [1] * n,
        "bytes": pa.array(list(pieces.values()), pa.binary()),
    })
    assert n > 40
    assert _judge(400)(group).num_rows <= 9 * n < windows / 4


def test_a_segment_alone_with_its_anchor_needs_no_shard(spark):
    from postpulse.llm.suffix_dedup import dealt_segments

    rows = [(1, 10, 3, 5, 404), (2, 11, 1, 5, 404), (2, 12, 1, 9, 408)]
    distinct = spark.createDataFrame(rows, "anchor bigint, digest bigint, n bigint, windows int, size int")
    shards = {r["digest"]: r["shard"] for r in dealt_segments(distinct, 1 << 19).collect()}
    assert shards == {10: None, 11: 0, 12: 0}


@pytest.mark.parametrize("ids", [[3], [-5, 7, 7, 2**62], list(range(10**6, 10**6 + 400))])
def test_signatures_travel_in_small_blocks(ids):
    from postpulse.llm.ngram_join import _pack, _unpack

    rng = np.random.default_rng(len(ids))
    sig = rng.integers(0, 2**46, 2000, dtype=np.uint64) + np.uint64(5 << 46)
    own = np.array(ids, np.int64)[rng.integers(0, len(ids), len(sig))]
    block = _pack(sig, own)
    assert sorted(zip(*(x.tolist() for x in _unpack(block)), strict=True)) == sorted(zip(sig.tolist(), own.tolist(), strict=True))
    assert len(block) < 9 * len(sig)  # a row of two numbers has 16


def test_a_common_passage_makes_no_candidates(spark, monkeypatch):
    """Chains of passages would put most documents into one cluster, whose comparison is quadratic."""
    from postpulse.llm import ngram_join

    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(i, f"{words(f'own{i}x', 120)} {words(f'passage{i // 30}x', 80)}") for i in range(60)]
    rows += [(60, f"{words('own7x', 120)} {words('passage0x', 78)} end")]
    seen = []

    def spy(edges, name, run=ngram_join.components):
        seen.append((name, edges.distinct().count()))
        return run(edges, name)

    monkeypatch.setattr(ngram_join, "components", spy)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 7 if i == 60 else i for i in range(61)}
    assert dict(seen)["jaccard-candidates"] == 1


@pytest.mark.parametrize("limit", [1, 200])
def test_large_clusters_are_cut_by_signatures(spark, limit):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(12)] + [(50, " ".join(base)), (50, "other words here")]
    docs = spark.createDataFrame([*rows, (None, " ".join(base))], "doc_id long, text string")
    whole = {tuple(r) for r in jaccard_classes(docs).collect()}
    assert {tuple(r) for r in jaccard_classes(docs, cluster_shingles=limit).collect()} == whole
    assert len({c for _, n, c in whole if n == 36}) < 12
