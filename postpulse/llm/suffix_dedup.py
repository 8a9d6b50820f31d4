"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

Every window of ``length`` bytes has an anchor, the k-gram with the smallest hash in it (k-grams
that anchor a large share of all windows come last, whatever their hash).  Equal
windows have equal anchors at equal places, so the windows of one anchor can be judged apart
from all others.  Consecutive windows with one anchor make a *segment*.  Anchors that occur
once are dropped; equal segments are combined to one row with a weight, and the windows of one
that has its anchor to itself all repeat.  The rest is dealt to shards by anchor.  In a shard the
segments are laid end to end, their suffix array is induced and common prefixes of at least
``length`` bytes tell which windows are equal.

An anchor with many different segments (a phrase that is everywhere) is cut into several
shards, and what repeats across them is found by blocks of consecutive windows.  All windows of
a block lie in its *hull* and share its *core*: equal hulls repeat as a whole, and a core that
occurs once repeats nowhere.  Only blocks that neither settles are cut into smaller ones, down
to single windows, so rows follow the segments and the edges of what repeats in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import attach, columns_of, maybe_in
from postpulse.llm.suffixes import common_prefixes, suffix_array
from postpulse.llm.textbytes import chunks, mix, piece_hashes, rolling_hashes, utf8
from postpulse.session import materialize

LENGTH = 400
#: Bytes of the k-grams that anchors are chosen from (or half of ``length``, if less).
GRAM = 48
#: Bytes of a shard; an anchor with more bytes than that in different segments is cut.
SHARD_BYTES = 1 << 19

_PLACE = 20  # bits of a position; texts are walked in pieces of at most 2**20 bytes
_LATE = np.uint64(1 << 63)
#: Windows of a block, from the first step across shards to the last (and at most a quarter of ``length``).
BLOCKS = (64, 8, 1)
#: An anchor with more than one in so many segments is common; at most so many are.
COMMON_SHARE = 10_000
#: Bytes of segments that are handed on at once.
_OUT_BYTES = 1 << 22


def _keys(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """A key for each row from its id and its whole text: equal rows have equal keys."""
    data, offsets = utf8(texts)
    keys = [hashlib.blake2b(b"%d|" % i if i is not None else b"|", digest_size=16) for i in ids.to_pylist()]
    for i, key in enumerate(keys):
        key.update(data[offsets[i] : offsets[i + 1]])
    return pa.array([k.digest() for k in keys], pa.binary())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        yield pa.RecordBatch.from_arrays([_keys(ids, texts), ids, texts], names=["key", "id", "text"])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(
    data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, common: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """(value, first window, number of windows, anchor, digest of the segment's bytes) of all
    segments of values that lie end to end; positions are relative to the value.  Hashes of
    ``common`` (sorted) are anchors only of windows that have no other."""
    gram = min(GRAM, length // 2)
    width = length - gram + 1
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    begins = np.arange(n - gram + 1)
    hashes = rolling_hashes(data, begins, begins + gram)
    keys = (hashes >> np.uint64(1)) & ~np.uint64((1 << _PLACE) - 1) | begins.astype(np.uint64)
    if common is not None and len(common):
        known = np.zeros(1 << _PLACE, bool)  # by the upper bits, so that few hashes are looked up
        known[common >> np.uint64(64 - _PLACE)] = True
        late = np.flatnonzero(known[hashes >> np.uint64(64 - _PLACE)])
        keys[late[np.isin(hashes[late], common)]] |= _LATE  # behind all others
    anchor = (_smallest(keys, width) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    value = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= offsets[value + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    chosen, whose = anchor[at], value[at]
    head = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (whose[1:] != whose[:-1])])
    first = at[head]
    count = np.diff(np.append(np.flatnonzero(head), len(at)))
    digest = piece_hashes(data, first, first + count + length - 1)
    digest = mix(digest + (anchor[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return value[first], first - offsets[value[first]], count, hashes[anchor[first]], digest


def _walk(data: np.ndarray, offsets: np.ndarray, length: int, common: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """segments() over any amount of text, in pieces that overlap by ``length`` - 1 bytes."""
    most = 1 << (_PLACE - 1)
    for first, last, part, at in chunks(data, offsets, most):
        if len(part) <= 1 << _PLACE:
            value, begin, *rest = segments(part, at, length, common)
            yield value + first, begin, *rest
            continue
        for start in range(0, len(part) - length + 1, most):  # one long value
            piece = part[start : start + most + length - 1]
            value, begin, *rest = segments(piece, np.array([0, len(piece)]), length, common)
            yield value + first, begin + start, *rest


def _anchors(length: int, common: np.ndarray | None = None, narrow: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the key is made here too: one Python worker for each task instead of two
            keys = None if narrow else _keys(batch.column(0), batch.column(1))
            for value, begin, count, anchor, digest in _walk(*utf8(batch.column(1)), length, common):
                if narrow:
                    found, times = np.unique(anchor.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["anchor", "n"])
                    continue
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), keys.take(pa.array(value)),
                    pa.array(begin, pa.int64()), pa.array(count.astype(np.int32)),
                ], names=["anchor", "digest", "key", "begin", "windows"])

    return run


def common_anchors(rows: DataFrame, length: int) -> np.ndarray:
    """Anchors of more than one in COMMON_SHARE segments (so at most COMMON_SHARE): phrases that
    stand in very many texts and would bring all their segments together for nothing."""
    times = materialize(
        rows.mapInArrow(_anchors(length, narrow=True), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"),
        "repeat-counts",
    )
    total = times.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = times.where((F.col("n") * COMMON_SHARE > total) & (F.col("n") > 16)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def _cut_segments(length: int):
    """Rows of (key, text, list of segments) to one row per segment with its bytes."""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["shard", "cut", "anchor", "digest", "n", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: list[tuple] = []
            held = 0
            for i, wanted in enumerate(batch.column("wanted")):
                for w in wanted.as_py():
                    begin, size = offsets[i] + w["begin"], w["windows"] + length - 1
                    out.append((w["shard"], w["cut"], w["anchor"], w["digest"], w["n"], data[begin : begin + size].tobytes()))
                    held += size
                    if held > _OUT_BYTES:
                        yield packed(out)
                        out, held = [], 0
            yield packed(out)

    return run


_BLOCKS = (
    "anchor bigint, digest bigint, begin int, end int, lead int, at int, low int, high int, "
    "hull binary, core binary, open boolean, bytes binary"
)


def repeated_windows(pieces: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, position, class of equal windows, weight of the class) of all windows."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    sa = suffix_array(text)
    prefixes = common_prefixes(text, sa)
    number = np.cumsum(prefixes[sa] < length) - 1  # suffixes that agree in ``length`` bytes
    owner = np.repeat(np.arange(len(pieces)), sizes)[sa]
    window = sa - starts[owner] + length <= sizes[owner]
    sa, number, owner = sa[window], number[window], owner[window]
    weight = np.bincount(number, weights=weights[owner])[number]
    return owner, sa - starts[owner], number, weight.astype(np.int64)


def _ranges(piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((at, piece))
    piece, at = piece[order], at[order]
    head = np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    tail = np.concatenate([head[1:], [True]]) if len(at) else head
    return piece[head], at[head], at[tail]


def _sizes(length: int) -> list[int]:
    return [size for size in BLOCKS if size == 1 or 4 * size <= length]


def _leads(pieces: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """Where each segment has its anchor first."""
    gram = min(GRAM, length // 2)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    begins = np.arange(len(text) - gram + 1)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(begins)]
    at = np.flatnonzero(rolling_hashes(text, begins, begins + gram).view(np.int64) == anchors[owner])
    piece, first = np.unique(owner[at], return_index=True)
    leads = np.empty(len(pieces), np.int64)
    leads[piece] = at[first] - starts[piece]
    return leads


def cut_blocks(
    pieces: list[bytes], leads: np.ndarray, piece: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, length: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """(range, begin of the full block, first window, last, digest of the hull, of the core) of all
    blocks that ranges of windows are cut into.  Places count from the anchor, so those of equal
    windows are equal.  The core is that of the full block also where a block is cut short."""
    first, last = low // size, high // size
    count = last - first + 1
    which = np.repeat(np.arange(len(low)), count)
    at = (first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * size
    begin, end = np.maximum(low[which], at), np.minimum(high[which], at + size - 1)
    hulls, cores = [], []
    for p, a, b, e in zip(piece[which].tolist(), at.tolist(), begin.tolist(), end.tolist(), strict=True):
        whole, lead = pieces[p], int(leads[p])
        hulls.append(hashlib.blake2b(whole[b + lead : e + lead + length], digest_size=16).digest())
        cores.append(hashlib.blake2b(whole[a + size - 1 + lead : a + lead + length], digest_size=16).digest())
    return which, at, begin, end, hulls, cores


def _block_rows(anchor, digest, lead, at, low, high, hulls, cores, is_open, whole) -> pa.Table:
    numbers = {"begin": low + lead, "end": high + lead, "lead": lead, "at": at, "low": low, "high": high}
    return pa.table({
        "anchor": pa.array(anchor, pa.int64()), "digest": pa.array(digest, pa.int64()),
        **{name: pa.array(v.astype(np.int32)) for name, v in numbers.items()},
        "hull": pa.array(hulls, pa.binary()), "core": pa.array(cores, pa.binary()),
        "open": pa.array(is_open, pa.bool_()), "bytes": pa.array(whole, pa.binary()),
    })


def _judge(length: int):
    """Per shard: ranges of windows that repeat in it.  Of a cut anchor also the distinct blocks
    of windows (open: with a window that is the only one so far), and with the first block of a
    segment its bytes."""

    def run(group: pa.Table) -> pa.Table:
        pieces = group.column("bytes").to_pylist()
        names = [group.column(c).to_numpy() for c in ("anchor", "digest")]
        weights = group.column("n").to_numpy()
        owner, at, number, weight = repeated_windows(pieces, weights, length)
        piece, low, high = _ranges(owner[weight > 1], at[weight > 1])
        n = len(piece)
        nothing = {"lead": pa.int32(), "at": pa.int32(), "low": pa.int32(), "high": pa.int32(), "hull": pa.binary(),
                   "core": pa.binary(), "open": pa.bool_(), "bytes": pa.binary()}
        ranges = pa.table({
            "anchor": names[0][piece], "digest": names[1][piece], "begin": low.astype(np.int32), "end": high.astype(np.int32),
            **{name: pa.nulls(n, kind) for name, kind in nothing.items()},
        })
        if not group.column("cut")[0].as_py():
            return ranges
        leads = _leads(pieces, names[0], length)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        single = np.zeros(sizes.sum() + 1, np.int64)
        single[1 + starts[owner] + at] = weight == 1
        single = np.cumsum(single)
        every = np.arange(len(pieces))
        which, at, low, high, hulls, cores = cut_blocks(pieces, leads, every, -leads, sizes - length - leads, _sizes(length)[0], length)
        begin = starts[which] + leads[which]
        is_open = single[begin + high + 1] > single[begin + low]
        kept = list({key: i for i, key in reversed(list(enumerate(zip(names[0][which].tolist(), low.tolist(), high.tolist(), hulls, strict=True))))}.values())[::-1]
        whole: dict[int, int] = {}
        for i in kept:
            whole.setdefault(int(which[i]), i)
        own = which[kept]
        return pa.concat_tables([ranges, _block_rows(
            names[0][own], names[1][own], leads[own], at[kept], low[kept], high[kept], [hulls[i] for i in kept],
            [cores[i] for i in kept], is_open[kept], [pieces[p] if whole[p] == i else None for p, i in zip(own.tolist(), kept, strict=True)],
        )])

    return run


def _finer(size: int, length: int):
    """Rows of (anchor, digest, lead, bytes, ranges of windows) to the blocks of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            piece = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            low, high, is_open = (np.array([w[c] for part in wanted for w in part], t) for c, t in (("low", np.int64), ("high", np.int64), ("open", bool)))
            anchor, digest, leads = (batch.column(c).to_numpy() for c in ("anchor", "digest", "lead"))
            pieces = batch.column("bytes").to_pylist()
            which, at, begin, end, hulls, cores = cut_blocks(pieces, leads, piece, low, high, size, length)
            own = piece[which]
            yield from _block_rows(
                anchor[own], digest[own], leads[own], at, begin, end, hulls, cores, is_open[which], [None] * len(own)
            ).to_batches()

    return run


def repeats_across(blocks: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, begin, end): ranges of open windows that repeat in another shard."""
    segments = blocks.where("bytes is not null").select("anchor", "digest", "lead", "bytes")
    sizes, found = _sizes(length), None
    place = ["anchor", "at", "core"]
    for finer in [*sizes[1:], None]:
        hulls = blocks.groupBy(*place, "low", "high", "hull").agg(
            F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("open"), F.min("digest").alias("digest")
        )
        again = hulls.where("n > 1 and open").select("anchor", "low", "high", "hull")
        whole = blocks.where("open").join(again, ["anchor", "low", "high", "hull"]).select("anchor", "digest", "begin", "end")
        found = whole if found is None else found.unionByName(whole)
        if finer is None:
            return found
        # one of equal hulls stands for all; a core with one hull, or without an open one, is settled
        hulls = materialize(hulls.withColumn("open", F.expr("open and n = 1")).drop("n"), "repeat-hulls")
        unsettled = hulls.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("any")).where("n > 1 and any")
        wanted = hulls.join(unsettled.select(*place), place, "left_semi").groupBy("anchor", "digest").agg(
            F.collect_list(F.struct("low", "high", "open")).alias("wanted")
        )
        blocks = materialize(
            segments.join(wanted, ["anchor", "digest"]).select("anchor", "digest", "lead", "bytes", "wanted")
            .mapInArrow(_finer(finer, length), _BLOCKS).drop("bytes"),
            "repeat-blocks",
        )


def dealt_segments(distinct: DataFrame, shard_bytes: int) -> DataFrame:
    """Segments with their shard; null for a segment that has its anchor to itself."""
    groups = materialize(distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes")
    ).where("segments > 1"), "repeat-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_bytes))
    cuts = F.when(F.col("bytes") > shard_bytes, F.ceil(F.col("bytes") / shard_bytes).cast("bigint"))
    return distinct.join(groups.select("anchor", cuts.alias("cuts"), F.lit(True).alias("several")), "anchor", "left").withColumn(
        "cut", F.col("cuts").isNotNull()
    ).withColumn(
        "shard",
        F.when(F.col("cut"), -1 - F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("digest"), F.col("cuts"))), F.lit(1 << 62)))
        .when(F.col("several"), F.pmod(F.xxhash64("anchor"), F.lit(shards))),
    )


def repeated_spans(rows: DataFrame, keyed: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans): for each row (id, text) with repeats, the ranges of its repeating windows.
    ``keyed`` has the same rows with their keys."""
    common = common_anchors(rows, length)
    anchors = materialize(
        rows.mapInArrow(_anchors(length, common), "anchor bigint, digest bigint, key binary, begin bigint, windows int"),
        "repeat-anchors",
    )
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = materialize(anchors.join(often, "anchor"), "repeat-shared")
    distinct = shared.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"), F.min(F.struct("key", "begin")).alias("at"),
    ).withColumn("size", F.col("windows") + F.lit(length - 1))
    distinct = materialize(distinct, "repeat-segments")
    dealt = dealt_segments(distinct, shard_bytes)
    wanted = dealt.where("shard is not null").groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct(
        "shard", "cut", "anchor", "digest", "n", F.col("at.begin").alias("begin"), "windows"
    )).alias("wanted"))
    wanted = materialize(wanted, "repeat-wanted")
    texts = maybe_in(keyed.select("key", "text"), wanted, "key").dropDuplicates(["key"]).join(wanted, "key")
    marks = materialize(
        texts.select("text", "wanted")
        .mapInArrow(_cut_segments(length), "shard bigint, cut boolean, anchor bigint, digest bigint, n bigint, bytes binary")
        .groupBy("shard").applyInArrow(_judge(length), _BLOCKS),
        "repeat-marks",
    )
    range_columns = ("anchor", "digest", "begin", "end")
    found = marks.where("hull is null").select(*range_columns)
    blocks = marks.where("hull is not null")
    if not blocks.isEmpty():
        found = found.unionByName(repeats_across(blocks, length))
    ranges = found.groupBy("anchor", "digest").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    # a segment that has its anchor to itself occurs more than once
    alone = dealt.where("shard is null").select(
        "anchor", "digest", F.array(F.struct(F.lit(0).alias("begin"), (F.col("windows") - 1).alias("end"))).alias("ranges"), "n"
    )
    classes = materialize(
        ranges.join(distinct.select("anchor", "digest", "n"), ["anchor", "digest"]).unionByName(alone)
        .select(F.struct("anchor", "digest").alias("segment"), "ranges", F.col("n").alias("weight")),
        "repeat-ranges",
    )
    members = shared.select(F.struct("anchor", "digest").alias("segment"), "key", F.col("begin").alias("at"))
    return attach(members, classes, "segment", "weight").where("ranges is not null").select(
        "key", F.explode("ranges").alias("r"), "at"
    ).groupBy("key").agg(F.collect_set(F.struct(
        (F.col("at") + F.col("r.begin")).alias("begin"), (F.col("at") + F.col("r.end") + length).alias("end")
    )).alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        spans, kept = [], []
        for i, found in enumerate(batch.column("spans").to_pylist()):
            merged: list[dict[str, int]] = []
            for s in sorted(found or [], key=lambda s: (s["begin"], s["end"])):
                if merged and s["begin"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            whole = data[offsets[i] : offsets[i + 1]]
            edges = [0, *[x for s in merged for x in (s["begin"], s["end"])], len(whole)]
            kept.append(b"".join(whole[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append(merged)
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array(np.diff(offsets)),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (removed, begin to end), kept (bytes).

    * Every byte covered by a string of ``length`` bytes that starts anywhere else too, in the
      same text or another, goes.  Strings are judged on the input and never cross texts.
    * A null text counts as empty; texts shorter than ``length`` stay whole.  ``kept`` may cut
      through a character, so it is bytes.
    * Repeated rows are different texts with equal bytes, so they remove each other; a null id is
      an id like any other.  Empty table: no rows.  Other columns are not looked at.
    """
    rows = columns_of(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    keyed = rows.mapInArrow(_keyed, "key binary, id bigint, text string")
    spans = repeated_spans(rows, keyed, length, shard_bytes)
    return keyed.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    )
