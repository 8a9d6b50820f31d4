"""WARC archives: pages written as records, and archives of any size read back in splits.

Writing.  A record is one string, header and block, written by Spark's text writer whose line
end is the record end; the payload is a HTTP answer.  Of pages with equal payloads (compared by
SHA-256) the one with the smallest id is a ``response``, the others are ``revisit`` records that
name it and hold the HTTP head only.  Only pages whose digest may be shared are shuffled with
their payload; the digests most often shared are broadcast (at most ``HOT_SHARE``).

Reading.  Spark's text reader deals out the lines of the archives in splits, whatever the length
of a file.  (The line end is one byte: Hadoop's reader repeats or misses rows where part of a
longer one stands at the end of a split or buffer.)  A line that begins with the magic ``WARC/1.``
may lie inside a payload, so it is only a *candidate*.  Its header names its length, hence its
successor:

1. each task cuts its split into segments, one from each candidate to the next, emits (candidate,
   successor), and follows successors inside the split: ``leaves`` is where the chain from that
   candidate goes on in a later split.  A header that the split's end cuts is completed from the
   beginning of the next split, so splits must be longer than headers;
2. lengths of splits summed along a file turn offsets in a split into offsets in the file;
3. only candidates that some ``leaves`` points at, and file starts, take part in pointer jumping:
   reached := reached + jump(reached), jump := jump of jump, until nothing is added;
4. each split is walked again from the candidates reached in it; all others are payload;
5. a record that candidates or ends of splits cut is put together from its segments, which a
   second read of the archives in the same splits finds by their place.

Nothing grows with the archives but narrow tables: one row a candidate, without its payload.

Defined results: a null payload is an empty one; a null url is left out of the header; pages that
repeat the id *and* the payload of a response are responses too; a null id stands after all
others, and among equal payloads without any id all are responses; columns besides the named
ones are not archived, whatever their names.  An archive is read from its start as far as its
chain holds: a header that cannot be read ends it, and a record cut off by the end of its file
has ``complete`` false.  No pages make an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm.common import attach, mark_maybe
from postpulse.session import materialize

#: Fixed values of the format.
MAGIC, RECORD_END, LINE_END = "WARC/1.", "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Longest part of a header that is looked for in the next split.
MOST_HEAD = 1 << 20
#: The chain goes on behind a candidate whose header ends in the next split.
_OPEN = -1
#: Ids in the archives' record ids.
_URN = "urn:page:"
_NO_ID = "urn:nopage"


def base32_sha1(value: Column) -> Column:
    """SHA-1 in base 32, upper case: four times 40 bits as eight digits."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(_URN), F.url_encode(value.cast("string"))), F.lit(_NO_ID))


def page_of(record_id: Column) -> Column:
    """The page id in a record id such as ``<urn:page:17>``; null if it holds none."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, f"^<{_URN}(.*)>$", 1), F.lit("")))


def _record(url: Column, payload: Column, own: Column, first: Column, date: str) -> Column:
    revisit = first.isNotNull()
    size = F.octet_length(payload)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE_END}Content-Type: text/html; charset=UTF-8{LINE_END}Content-Length: "),
        size.cast("string"), F.lit(RECORD_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    address = url
    for found, code in (("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        address = F.replace(address, F.lit(found), F.lit(code))
    return F.concat(
        F.lit(f"{MAGIC}1{LINE_END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{LINE_END}WARC-Record-ID: <"), own, F.lit(f">{LINE_END}WARC-Date: {date}{LINE_END}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), address, F.lit(LINE_END)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(payload), F.lit(LINE_END),
        F.coalesce(F.concat(
            F.lit("WARC-Refers-To: <"), first, F.lit(f">{LINE_END}WARC-Profile: {PROFILE}{LINE_END}")
        ), F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE_END}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    )


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
    least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z",
) -> None:
    """Archives in folder ``path``, one a task.  Payloads under ``least_bytes`` are never revisited."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = materialize(
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"),
        "warc-shared",
    )
    marked = mark_maybe(rows, shared, "digest", "maybe")
    alone = marked.where("not maybe").drop("maybe").withColumn("first", F.lit(None).cast(rows.schema["id"].dataType))
    others = attach(marked.where("maybe").drop("maybe"), shared, "digest", "times")
    refers = F.expr("if(first is null or id <=> first, null, first)")
    record = _record(
        F.col("url"), F.col("payload"), _urn(F.col("id")), F.when(refers.isNotNull(), _urn(refers)), date
    )
    alone.unionByName(others).select(record.alias("record")).write.option("lineSep", RECORD_END).text(path)


# ---------------------------------------------------------------------------- reading


def _headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split(LINE_END)[1:]:
        if name and line[:1] in (" ", "\t"):
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _facts(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None]:
    """Length and digest of the full payload; of a revisit those that its record names."""
    payload = block
    http: dict[str, str] = {}
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, found, payload = block.partition(RECORD_END.encode())
        http = _headers(head) if found else {}
    if headers.get("warc-type") != "revisit":
        return len(payload), _digest(payload)
    named = http.get("content-length", "")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    return int(named) if named.isdecimal() else None, digest if algorithm.lower() == "sha1" else None


_SEGMENT = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("step", pa.int64()), ("candidate", pa.bool_()),
    ("next", pa.int64()), ("leaves", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("head_bytes", pa.int64()),
    ("content_bytes", pa.int64()), ("whole", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("open_head", pa.binary()), ("rest", pa.binary()),
])
_HEADER_DDL = "headers map<string, string>, head_bytes bigint, content_bytes bigint"
_SEGMENT_DDL = (
    f"file string, block bigint, at bigint, step bigint, candidate boolean, next bigint, leaves bigint, {_HEADER_DDL}, "
    "whole boolean, payload_bytes bigint, payload_digest string, open_head binary, rest binary"
)


def _parsed(value: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers of a record that begins here, and the lengths of header and content."""
    end = value.find(RECORD_END.encode())
    headers = _headers(value[:end]) if end >= 0 else {}
    size = headers.get("content-length", "")
    return (headers, end + len(RECORD_END), int(size)) if size.isascii() and size.isdecimal() else None


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, bool]]:
    """(file, block), offset in the block, bytes, whether it is the block's last; of each segment.

    Batches hold lines in order; a block's first segment need not begin with a candidate.
    """
    key, at, parts = None, 0, []
    for batch in batches:
        runs = pc.run_end_encode(batch.column("split"))
        low = 0
        for high in runs.run_ends.to_pylist():
            now = (batch.column("file")[low].as_py(), batch.column("block")[low].as_py())
            lines = batch.column("value").slice(low, high - low)
            if now != key:
                if parts:
                    yield key, at, b"".join(parts), True
                key, at, parts = now, 0, []
            starts = pc.indices_nonzero(pc.starts_with(lines, MAGIC.encode())).to_pylist()
            cuts = [0, *(x for x in starts if x), len(lines)]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines), b"\n")
            for i, part in enumerate(joined):
                if parts and (i or starts[:1] == [0]):
                    value = b"".join(parts)
                    yield key, at, value, False
                    at, parts = at + len(value), []
                parts += [part.as_py(), b"\n"]
            low = high
    if parts:
        yield key, at, b"".join(parts), True


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for key, at, value, last in _segments(batches):
        row = [*key, at, len(value), value.startswith(MAGIC.encode()), None, None, {}, None, None, False, None, None, None, None]
        known = _parsed(value) if row[4] else None
        if known:
            headers, head, size = known
            row[5:11] = at + head + size + len(RECORD_END), None, headers, head, size, head + size <= len(value)
            if row[10]:
                row[11:13] = _facts(headers, value[head : head + size])
        elif row[4] and last and RECORD_END.encode() not in value:
            row[6], row[13] = _OPEN, value
        elif not row[4] and not rows:
            blank = LINE_END.encode() if value.startswith(LINE_END.encode()) else RECORD_END.encode()
            end = value.find(blank)
            row[14] = value[: end + len(blank)] if end >= 0 else value[:MOST_HEAD]
        rows.append(row)
        if last:
            leaves = {}
            for row in reversed(rows):  # successors lie behind, so theirs are known
                if row[5] is not None:
                    row[6] = leaves.get(row[5], row[5])
                if row[4]:
                    leaves[row[2]] = row[6]
            for low in range(0, len(rows), 4096):
                columns = zip(*rows[low : low + 4096], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _SEGMENT, strict=True)], schema=_SEGMENT
                )
            rows = []


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), at, value, _ in _segments(batches):
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "place": at, "value": value}])


@contextmanager
def _same_splits(spark: SparkSession):
    """While it holds, splits depend on the files alone and not on the executors there are."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.concat_ws(" ", block.cast("string"), file).alias("split"), file.alias("file"), block.alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            known = _parsed(row["open_head"] + (row["next_rest"] or b""))
            if known:
                rows.append((row["file"], row["block"], *known))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        names = ["file", "block", "headers", "head_bytes", "content_bytes"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, _SEGMENT.field(n).type) for c, n in zip(columns, names, strict=True)], names=names
        )


def _reached(nodes: DataFrame) -> DataFrame:
    """Nodes (file, at, to) that the chain from each file's start goes through, by pointer jumping."""
    known, jump = nodes.where(F.col("at") == 0).select("file", "at"), nodes
    n, before = known.count(), -1
    while n > before:
        there = known.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = materialize(
            known.unionByName(there.join(nodes, ["file", "at"], "left_semi")).distinct(), "warc-reached"
        )
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("after"))
        jump = materialize(jump.join(ahead, ["file", "to"]).select("file", "at", F.col("after").alias("to")), "warc-jump")
        before, n = n, known.count()
    return known


def _walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Which candidates of a split the chain goes through, and before each other the last of these."""
    left = left.sort_by("at")
    ats, nexts = left.column("at").to_pylist(), left.column("next").to_pylist()
    place = {at: i for i, (at, yes) in enumerate(zip(ats, left.column("candidate").to_pylist(), strict=True)) if yes}
    hit = [False] * len(ats)
    for start in right.column("at").to_pylist():
        i = place.get(start)
        while i is not None and not hit[i]:
            hit[i] = True
            i = place.get(nexts[i])
    owners, last = [], None
    for at, yes in zip(ats, hit, strict=True):
        last = at if yes else last
        owners.append(last)
    return left.append_column("hit", pa.array(hit, pa.bool_())).append_column("owner", pa.array(owners, pa.int64()))


def _contents(spark: SparkSession, path: str, walked: DataFrame, chosen: DataFrame) -> DataFrame:
    """(file, at, content) of chosen records: their segments, found by place in a second read."""
    per_block = walked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.withColumn("carried", F.max("last").over(earlier)).drop("last")
    owned = walked.join(carried, ["file", "block"]).select(
        "file", "block", "place", "at", F.coalesce("owner", "carried").alias("owner")
    )
    wanted = chosen.select("file", F.col("at").alias("owner"), "next", "head_bytes", "content_bytes")
    parts = materialize(owned.join(wanted, ["file", "owner"]).where(F.col("at") < F.col("next")), "warc-parts")
    key = F.concat_ws(" ", F.col("place").cast("string"), F.col("block").cast("string"), "file")
    keys = parts.select(key.alias("key"))
    with _same_splits(spark):
        values = _lines(spark, path).mapInArrow(_values, "file string, block bigint, place bigint, value binary")
        found = materialize(mark_maybe(values.withColumn("key", key), keys, "key", "maybe").where("maybe").drop("maybe", "key"), "warc-values")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("text"))))
    return (
        parts.join(found, ["file", "block", "place"]).groupBy("file", "owner", "head_bytes", "content_bytes")
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").cast("binary").alias("joined"))
        .select(
            "file", F.col("owner").alias("at"),
            F.expr("substring(joined, cast(head_bytes + 1 as int), cast(content_bytes as int))").alias("content"),
        )
    )


def _facts_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = [
            (*_facts(dict(h), content), len(content) == size)
            for h, content, size in zip(*(batch.column(c).to_pylist() for c in ("headers", "content", "content_bytes")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([
            batch.column("file"), batch.column("at"), pa.array([k[0] for k in known], pa.int64()),
            pa.array([k[1] for k in known], pa.string()), pa.array([k[2] for k in known], pa.bool_()),
        ], names=["file", "at", "payload_bytes", "payload_digest", "complete"])


def read_warc(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """One row per record of the archives in ``path``: file, offset, headers (names in lower case),
    content_bytes, payload_bytes, payload_digest, complete; with ``contents`` also the block."""
    with _same_splits(spark):
        segments = materialize(_lines(spark, path).mapInArrow(_candidates, _SEGMENT_DDL), "warc-segments")
    along = Window.partitionBy("file").orderBy("block")
    splits = segments.groupBy("file", "block").agg(
        F.sum("step").alias("bytes"), F.first("rest", True).alias("rest"), F.first("open_head", True).alias("open_head"),
        F.max(F.when(F.col("open_head").isNotNull(), F.col("at"))).alias("open_at"),
    ).select(
        "file", "block", "open_head", "open_at", F.lead("rest").over(along).alias("next_rest"),
        F.coalesce(F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    opened = splits.where("open_at is not null").select("file", "block", "open_head", "next_rest").mapInArrow(
        _openings, f"file string, block bigint, {_HEADER_DDL}"
    )
    own = ("headers", "head_bytes", "content_bytes")
    splits = materialize(splits.join(opened, ["file", "block"], "left").select(
        "file", "block", "base", "open_at", F.struct(*own).alias("opened"),
        F.expr(f"base + open_at + head_bytes + content_bytes + {len(RECORD_END)}").alias("behind"),
    ), "warc-splits")
    is_open = F.col("at") == F.col("open_at")
    placed = segments.join(splits, ["file", "block"]).select(
        "file", "block", F.col("at").alias("place"), (F.col("at") + F.col("base")).alias("at"), "candidate",
        F.when(is_open, F.col("behind")).otherwise(F.col("next") + F.col("base")).alias("next"),
        F.when(F.col("leaves") == _OPEN, F.col("behind")).otherwise(F.col("leaves") + F.col("base")).alias("leaves"),
        *[F.when(is_open, F.col("opened")[c]).otherwise(F.col(c)).alias(c) for c in own],
        "whole", "payload_bytes", "payload_digest",
    )
    targets = placed.where("leaves is not null").select("file", F.col("leaves").alias("at"))
    roots = splits.select("file", F.lit(0).cast("bigint").alias("at"))
    nodes = materialize(
        placed.where("candidate").select("file", "block", "at", F.col("leaves").alias("to"))
        .join(targets.unionByName(roots).distinct(), ["file", "at"]),
        "warc-nodes",
    )
    reached = _reached(nodes.select("file", "at", "to")).join(nodes.select("file", "block", "at"), ["file", "at"])
    keys = ["file", "block"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    walked = materialize(
        placed.groupBy(*keys).cogroup(reached.groupBy(*keys)).applyInArrow(_walk, f"{kinds}, hit boolean, owner bigint"),
        "warc-walked",
    )
    records = walked.where("hit and next is not null")
    named = ["file", F.col("at").alias("offset"), "headers", "content_bytes", "payload_bytes", "payload_digest"]
    result = records.where("whole").select(*named, F.lit(True).alias("complete"))
    cut = records.where("not whole")
    if not cut.isEmpty():
        joined = _contents(spark, path, walked, cut).join(cut.select("file", "at", "headers", "content_bytes"), ["file", "at"])
        facts = joined.select("file", "at", "headers", "content", "content_bytes").mapInArrow(
            _facts_of_batches, "file string, at bigint, payload_bytes bigint, payload_digest string, complete boolean"
        )
        rest = cut.drop("payload_bytes", "payload_digest").join(facts, ["file", "at"]).select(*named, "complete")
        result = result.unionByName(rest)
    if contents:
        blocks = _contents(spark, path, walked, records).select("file", F.col("at").alias("offset"), "content")
        result = result.join(blocks, ["file", "offset"])
    return result
