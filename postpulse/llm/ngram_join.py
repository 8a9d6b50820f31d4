"""N-gram Jaccard join by rare shingles and PartEnum signatures; classes of linked documents.

A link needs ``percent`` of the larger set's elements in common, so linked sets have one of their
rarest elements in common: of a set of n, one of the ``n - ceil(n * percent / 100) + 1`` that the
fewest sets have (ties by value).  Elements that no other set has count first and need not be
sent, so a document with enough words of its own has no candidates, however many share a
passage with it.  Numbers of sets are counted by bucket of elements, each set's rarest are chosen by
part of ids, and both travel in packed blocks.

Sets with a rare element in common make candidate clusters, components of the stars around the
smallest id.  A cluster that is too large for a task is cut by signatures.
Jaccard similarity g of sets with at most u elements means that at most
``k = 2 u (1 - g) / (1 + g)`` elements differ.  Sizes are cut into bands whose bounds grow by
1 / g, so linked sets are in the same band or in neighbouring ones; a set gives signatures for
its own band (as the larger set) and for the next one (as the smaller).  Within a band the
domain is split into ``n1 = k // (k2 + 1) + 1`` parts of ``n2`` pieces each: some part has at
most ``k2`` differing pieces, so one of its subsets of ``n2 - k2`` pieces is equal in both
sets.  Each subset's digest is a signature; linked sets share at least one.

Inside a cluster every set is read once and compared with the sets that are not linked
yet, first by a sketch that can't miss a link, then exactly.  No pairs are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import attach, columns_of, maybe_in
from postpulse.llm.components import components
from postpulse.llm.textbytes import mix, shingle_sets
from postpulse.session import materialize

#: Words of a shingle and percentage of similarity, where the caller states none.
WORDS, PERCENT = 5, 80
#: Shingles that one comparing task may hold; larger clusters are compared in parts.
CLUSTER_SHINGLES = 4_000_000
#: Pieces of a part that may differ, and elements that a signature should cover on average:
#: signatures of fewer elements bring together sets that only share a passage.
DIFFER, COVERED = 1, 6.5
#: Shingles or signatures that a task combines before it sends them.
COMBINE = 400_000
#: Shingles or signatures (about three for each shingle) of a bucket, and the fewest buckets.
BUCKET, BUCKETS = 1_000_000, 64

_EMPTY = np.uint64(0)


def differing(size: int, percent: int) -> int:
    """Elements that can differ between linked sets of at most ``size`` elements."""
    return 2 * size * (100 - percent) // (100 + percent)


def band_of(size: int, percent: int) -> tuple[int, int]:
    """(band, its largest size).  The bounds are 1, then the largest size that can be linked
    with one more than the bound before, so a link never skips a band."""
    band, top = 0, 1
    while size > top:
        band, top = band + 1, (top + 1) * 100 // percent
    return band, top


def pieces_for(percent: int, differ: int = DIFFER) -> int:
    """Pieces of a part: the fewest, up to four, that let a signature cover COVERED elements."""
    if percent >= 100:
        return differ + 1
    per_difference = (100 + percent) / (2 * (100 - percent))
    few = range(differ + 1, 4)
    return next((n for n in few if (differ + 1) * (n - differ) / n * per_difference >= COVERED), 4)


def _digests(own: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of mixed elements, number of elements) of each piece of the domain."""
    spread = mix(own ^ np.uint64(0x5851F42D4C957F2D))
    piece = ((spread >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(piece.astype(np.uint16) if pieces < 65536 else piece, kind="stable")
    sums = np.concatenate([[np.uint64(0)], np.cumsum(spread[order])])
    counts = np.bincount(piece, minlength=pieces)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return sums[ends[1:]] - sums[ends[:-1]], counts


def signatures(own: np.ndarray, percent: int, pieces: int | None = None, differ: int = DIFFER) -> np.ndarray:
    """Signatures of a set for its own band and the next.

    A subset without elements says nothing, so it is left out, unless the set has so many of
    them that two such sets could agree in nothing else: with ``spare`` parts more than needed,
    linked sets agree in at least ``spare + 1`` parts, so a set gives its empty subsets only
    if more than ``spare`` parts have one.
    """
    band, top = band_of(len(own), percent)
    pieces = pieces or pieces_for(percent, differ)
    out = []
    for number, most in ((band, top), (band + 1, (top + 1) * 100 // percent)):
        if number > band and (len(own) * 100) // percent <= top:
            continue  # no linked set is as large as the next band
        k = differing(most, percent)
        need = k // (differ + 1) + 1 if k else 1
        spare = 1 + need // 8 if k else 0
        parts = need + spare
        n2, k2 = (pieces, differ) if k else (1, 0)
        sums, counts = _digests(own, parts * n2)
        sums, counts = sums.reshape(parts, n2), counts.reshape(parts, n2)
        tag = (np.arange(parts, dtype=np.uint64) << np.uint64(16)) + (np.uint64(number) << np.uint64(48))
        found, full, hollow = [], [], np.zeros(parts, bool)
        for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
            columns = list(chosen)
            # the columns differ in place, so each sum is mixed before they are added
            value = sum((mix(sums[:, c] + np.uint64(c + 1)) for c in columns), np.zeros(parts, np.uint64))
            found.append(mix(value ^ mix(tag + np.uint64(i + 1))))
            full.append(counts[:, columns].sum(axis=1) > 0)
            hollow |= ~full[-1]
        found, full = np.concatenate(found), np.concatenate(full)
        out.append(found if hollow.sum() > spare else found[full])
    return np.concatenate(out)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for own in shingle_sets(batch.column(1), k):
                sizes.append(len(own))
                both = np.array([mix(own ^ np.uint64(s)).sum(dtype=np.uint64) for s in (11, 29)], np.uint64)
                digests.append(both.tobytes() + len(own).to_bytes(4, "little") if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["id", "size", "digest"]
            )

    return run


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _star(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, smallest id of each, and the pairs (smallest, other))."""
    order = np.argsort(sig)
    sig, ids = sig[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    least = np.minimum.reduceat(ids, at)
    smallest = np.repeat(least, np.diff(np.append(at, len(sig))))
    other = smallest != ids
    return sig[at], least, *_distinct_pairs(smallest[other], ids[other])


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as their bytes, all lowest ones first, without the highest that are all zero."""
    width = -(-int(values.max(initial=0)).bit_length() // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        whole[:, : len(planes)] = planes.T
    return whole.reshape(-1).view("<u8").astype(np.uint64)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values[:1])


def _pack(sig: np.ndarray, ids: np.ndarray) -> bytes:
    """(sig, id) rows as one block: rising signatures and the ids among them as steps, and each row's
    place among those ids.  A block takes about half the bytes that its rows would take."""
    order = np.argsort(sig, kind="stable")
    known, place = np.unique(ids[order], return_inverse=True)
    rising = sig[order], known.view(np.uint64)
    parts = [*(_planes(_steps(values)) for values in rising), _planes(place.astype(np.uint64))]
    sizes = np.array([len(sig), len(known), *map(len, parts[:2])], "<u4")
    return b"".join([sizes.tobytes(), *(values[:1].astype("<u8").tobytes() for values in rising), *parts])


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, first, second = np.frombuffer(block, "<u4", 4).tolist()
    starts = np.frombuffer(block, "<u8", 2, 16).astype(np.uint64)
    at = np.cumsum([32, first, second])
    sig = np.cumsum(_from_planes(block[at[0] : at[1]], n), dtype=np.uint64) + starts[0]
    known = (np.cumsum(_from_planes(block[at[1] : at[2]], m), dtype=np.uint64) + starts[1]).view(np.int64)
    return sig, known[_from_planes(block[at[2] :], n).astype(np.int64)]


def _blocks(rows: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(number, id) rows as a block for each bucket of numbers below 2**48 that has any."""
    order = np.argsort(rows)
    rows, ids = rows[order], ids[order]
    bucket = ((rows >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))[: len(rows) + 1]
    blocks = [_pack(rows[low:high], ids[low:high]) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _sign(k: int, percent: int, buckets: int):
    """Blocks of (sig, id) rows, one for each bucket of signatures that a task's batch has.  A pair
    that a task finds itself is sent as two rows of a signature made from the smaller id, so that it
    needs no column of its own."""

    def send(sig: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        s, smallest, a, b = _star(np.concatenate(sig), np.concatenate(ids))
        named = mix(a.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
        heads, first = np.unique(named, return_index=True)
        # the last bytes are not needed to tell signatures apart: equal ones are candidates only
        return _blocks(np.concatenate([s, named, heads]) >> np.uint64(16), np.concatenate([smallest, b, a[first]]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ids, held = [], [], 0
        for batch in batches:
            for i, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(own):
                    found = signatures(own, percent)
                    sig.append(found)
                    ids.append(np.full(len(found), i, np.int64))
                    held += len(found)
                if held >= COMBINE:
                    yield send(sig, ids)
                    sig, ids, held = [], [], 0
        if held:
            yield send(sig, ids)

    return run


def _deal(k: int, buckets: int):
    """Blocks of (shingle, id) rows.  Of the equal sets that a task's batch has the one with the smallest id
    is sent.  The last bytes are not needed to tell shingles apart: equal ones are candidates only."""

    def send(sets: dict[tuple, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids = np.array([i for i, _ in sets.values()], np.int64)
        own = [s for _, s in sets.values()]
        return _blocks(np.concatenate(own) >> np.uint64(16), np.repeat(ids, [len(s) for s in own]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for batch in batches:
            for i, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(own):
                    known = (len(own), int(own[0]), int(own.sum(dtype=np.uint64)))
                    held += len(own) if known not in sets else 0
                    if known not in sets or i < sets[known][0]:
                        sets[known] = (i, own)
                if held >= COMBINE:
                    yield send(sets)
                    sets, held = {}, 0
        if held:
            yield send(sets)

    return run


def _shared(buckets: int):
    """Of the blocks of a bucket: the shingles of more than one row, as blocks by id of (id, shingle, rows)."""

    def run(group: pa.Table) -> pa.Table:
        rows = [_unpack(block) for block in group.column("block").to_pylist()]
        shingle, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
        _, place, n = np.unique(shingle, return_inverse=True, return_counts=True)
        n = n[place]
        shingle, ids, n = shingle[n > 1], ids[n > 1], n[n > 1].astype(np.uint64)
        part = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((ids, part))
        shingle, ids, n, part = shingle[order], ids[order], n[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))[: len(part) + 1]
        blocks = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            own = ids[low:high]
            known = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts = [_planes(_steps(known.view(np.uint64))), _planes(np.searchsorted(known, own).astype(np.uint64)), _planes(n[low:high]),
                     _planes(shingle[low:high])]
            sizes = np.array([high - low, len(known), *map(len, parts[:3])], "<u4")
            blocks.append(b"".join([sizes.tobytes(), known[:1].astype("<i8").tobytes(), *parts]))
        return pa.table({"part": pa.array(part[edges[:-1]], pa.int32()), "shared": pa.array(blocks, pa.binary())})

    return run


def _read_shared(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, *sizes = np.frombuffer(block, "<u4", 5).tolist()
    at = np.cumsum([28, *sizes])
    known = (np.cumsum(_from_planes(block[at[0] : at[1]], m), dtype=np.uint64) + np.frombuffer(block, "<i8", 1, 20).view(np.uint64)).view(np.int64)
    place, rows = (_from_planes(block[low:high], n) for low, high in zip(at[1:3], at[2:4], strict=True))
    return known[place.astype(np.int64)], _from_planes(block[at[3] :], n), rows


def _parted(sets: DataFrame, buckets: int) -> DataFrame:
    """``sets`` with the part that blocks by id have for their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = (mix(batch.column("id").to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    return sets.mapInArrow(run, "part int, id bigint, size bigint, times bigint")


def _rarest(percent: int, buckets: int):
    """Of the sets of a part: blocks of (shingle, id) rows of as many of each set's rarest shingles as
    linked sets can't both miss.  Those that no other set has are the rarest, and need not be sent."""

    def run(blocks: pa.Table, sets: pa.Table) -> pa.Table:
        if not blocks.num_rows or not sets.num_rows:
            return pa.Table.from_batches([_blocks(np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets)])
        read = [_read_shared(block) for block in blocks.column("shared").to_pylist()]
        ids, shingle, rows = (np.concatenate(x) for x in zip(*read, strict=True))
        sets = sets.sort_by("id")
        known, size, times = (sets.column(c).to_numpy() for c in ("id", "size", "times"))
        order = np.lexsort((shingle, rows, ids))
        ids, shingle = ids[order], shingle[order]
        first = np.searchsorted(ids, known, "left")
        shared = np.searchsorted(ids, known, "right") - first
        wanted = size - -(-size * percent // 100) + 1 - (size - shared)
        # texts that share an id send all that others have
        wanted = np.where(times > 1, shared, np.clip(wanted, 0, shared))
        at = np.repeat(first - np.cumsum(wanted) + wanted, wanted) + np.arange(wanted.sum())
        return pa.Table.from_batches([_blocks(shingle[at], ids[at], buckets)])

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Of the blocks of a bucket: each id with the smallest of its signature."""
    rows = [_unpack(block) for block in group.column("block").to_pylist()]
    _, _, a, b = _star(*(np.concatenate(x) for x in zip(*rows, strict=True)))
    return pa.table({"a": a, "b": b})


#: Fields of the two sketches; a set that differs in d elements differs in at most d fields.
_FINE, _COARSE = 256, 64


def _sketch(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, _ = _digests(own, _FINE)
    coarse = sums.reshape(_COARSE, -1).sum(axis=1, dtype=np.uint64)
    return (mix(sums) >> np.uint64(56)).astype(np.uint8), (mix(coarse) >> np.uint64(56)).astype(np.uint8)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component number of each set: a walk in which every set met is compared with all
    sets not met yet, so a pair is passed over only if it is in one component already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    fine, coarse = (np.stack(x) for x in zip(*map(_sketch, sets), strict=True))
    limit = 2 * (100 - percent) / (100 + percent)
    open_, number, found = np.ones(n, bool), np.zeros(n, np.int64), 0
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        waiting, number[seed] = [seed], found
        while waiting:
            x = waiting.pop()
            low = np.searchsorted(sizes, -(-int(sizes[x]) * percent // 100), "left")
            high = np.searchsorted(sizes, int(sizes[x]) * 100 // percent, "right")
            near = low + np.flatnonzero(open_[low:high])
            if not len(near):
                continue
            most = np.floor((sizes[near] + sizes[x]) * limit / 2 + 1e-9).astype(np.int64)
            near = near[(coarse[near] != coarse[x]).sum(axis=1) <= most] if most.min() < _COARSE else near
            most = np.floor((sizes[near] + sizes[x]) * limit / 2 + 1e-9).astype(np.int64)
            if len(near) and most.min() < _FINE:
                near = near[(fine[near] != fine[x]).sum(axis=1) <= most]
            for y in near:
                common = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                    open_[y] = False
                    number[y] = found
                    waiting.append(y)
        found += 1
    back = np.empty(n, np.int64)
    back[order] = number
    return back


def _link(k: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        sets = [own for part in group.column("text").chunks for own in shingle_sets(part, k)]
        number = linked(sets, percent)
        smallest = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, number, ids)
        root = smallest[number]
        other = root != ids
        return pa.table({"a": root[other], "b": ids[other]})

    return run


def _tasks(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """``members`` (id, cluster, size) with the tasks in which each is compared.

    A cluster of at most ``limit`` shingles is one task.  A larger one is cut by size: linked sets
    are in one band or in neighbouring ones, so there is a task for each band and the next, and
    a set is in two.  If these still hold more than ``limit``, their sets are cut by a hash of the
    id into parts, and there is a task for each two parts.
    """
    totals = members.groupBy("cluster").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    ratio = math.log(100 / percent) * (1 + 1e-6)  # so that rounding never puts a link two bands apart
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(ratio)).cast("int")
    known = members.join(totals.where("n > 1"), "cluster").withColumn(
        "in_band", F.explode(F.when(F.col("total") <= limit, F.array(F.lit(0))).otherwise(F.array(band - 1, band)))
    )
    held = known.groupBy("cluster", "in_band").agg(F.sum("size").alias("held"))
    split = F.when(F.col("held") <= limit, 1).otherwise(F.ceil(2 * F.col("held") / F.lit(limit)))
    return (
        known.join(held.select("cluster", "in_band", split.cast("int").alias("parts")), ["cluster", "in_band"])
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "id", "cluster", "in_band",
            F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        )
    )


def _narrowed(members: DataFrame, named: DataFrame, words: int, percent: int, limit: int) -> DataFrame:
    """``members`` with clusters of more than ``limit`` shingles cut into the sets that signatures bring together."""
    totals = members.groupBy("cluster").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    large = materialize(
        members.join(totals.where((F.col("total") > limit) & (F.col("n") > 2)).select("cluster"), "cluster"), "jaccard-large"
    )
    shingles = large.agg(F.sum("size")).first()[0]
    if not shingles:
        return members
    signed = maybe_in(named, large, "id").join(large.select("id").distinct(), "id", "left_semi")
    buckets = max(BUCKETS, -(-3 * shingles // BUCKET))
    found = (
        signed.mapInArrow(_sign(words, percent, buckets), "bucket int, block binary")
        .groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint")
    )
    roots = components(found, "jaccard-signed").withColumnRenamed("node", "id")
    narrow = large.join(roots, "id", "left").select(
        "id", F.xxhash64("cluster", F.coalesce("root", "id")).alias("cluster"), "size"
    )
    return members.join(large.select("cluster").distinct(), "cluster", "left_anti").select("id", "cluster", "size").unionByName(narrow)


def _repeated_ids(told: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of the texts that share an id (there are none as a rule)."""
    known = told.where("id is not null and size > 0")
    ids = known.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    if ids.isEmpty():
        return told.sparkSession.createDataFrame([], "a bigint, b bigint")
    reps = known.join(ids.select("id"), "id", "left_semi").join(classes, "digest").select("id", "rep").distinct()
    return reps.join(reps.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    percent: int = PERCENT, cluster_shingles: int = CLUSTER_SHINGLES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    * A set: the distinct runs of ``words`` words after lower-casing A-Z; fewer words: the whole
      sequence; no words, empty or null text: the empty set, linked with nothing.
    * Link: 100 * common >= percent * union.  component_id: the smallest id reachable by links.
    * Equal sets are one class from the start, so a text repeated in a third of all rows is
      compared once.  Texts with words that share an id count as one document.
    * A row with a null id has its n_shingles, a null component_id and no links.
    * Empty table: no rows.  Other columns are not looked at.
    """
    rows = columns_of(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    told = materialize(rows.mapInArrow(_describe(words), "id bigint, size bigint, digest binary"), "jaccard-sets")
    classes = materialize(
        told.where("id is not null and size > 0").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")),
        "jaccard-classes",
    )
    named = rows.where("id is not null")
    sets = told.where("id is not null and size > 0")
    shingles = sets.agg(F.sum("size")).first()[0] or 0
    buckets = max(BUCKETS, -(-shingles // BUCKET))
    shared = (
        named.mapInArrow(_deal(words, buckets), "bucket int, block binary")
        .groupBy("bucket").applyInArrow(_shared(buckets), "part int, shared binary")
    )
    sizes = sets.groupBy("id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("times"))
    found = (
        shared.groupBy("part").cogroup(_parted(sizes, buckets).groupBy("part"))
        .applyInArrow(_rarest(percent, buckets), "bucket int, block binary")
        .groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint")
    )
    clusters = components(found, "jaccard-candidates")
    reps = classes.select(F.col("rep").alias("node"), "size")
    members = clusters.join(reps, "node").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "size")
    members = materialize(members, "jaccard-members")
    narrowed = _narrowed(members, named, words, percent, cluster_shingles)
    tasks = materialize(_tasks(narrowed, percent, cluster_shingles), "jaccard-tasks")
    links = (
        maybe_in(named, tasks, "id").join(tasks, "id")
        .groupBy("cluster", "in_band", "low", "high").applyInArrow(_link(words, percent), "a bigint, b bigint")
    )
    roots = components(links.unionByName(_repeated_ids(told, classes)), "jaccard-links")
    answers = materialize(
        classes.join(roots, classes["rep"] == roots["node"], "left")
        .select("digest", "rows", F.coalesce("root", "rep").alias("root")),
        "jaccard-answers",
    )
    return attach(told, answers, "digest", "rows").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
    )
