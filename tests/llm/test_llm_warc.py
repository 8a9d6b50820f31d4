"""Archives against a sequential reader, with splits of any size."""

import base64
import hashlib
import random
from pathlib import Path

import pytest

from postpulse.llm.warc import MAGIC, read_warc, write_warc


def record(name, payload, kind="response", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{name}>\r\n{extra}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def sequential(data):
    """Offset, id, length and digest of each record, read one after the other."""
    at, found = 0, []
    while data.startswith(b"WARC/1.", at):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n") if ": " in x)
        size = int(fields["Content-Length"])
        payload = data[end : end + size]
        found.append((at, fields["WARC-Record-ID"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()))
        at = end + size + 4
    return found


@pytest.fixture
def splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", min(size, 1 << 12))

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [701, 1 << 20])
def test_magic_in_payloads_and_across_splits(spark, splits, tmp_path, size):
    rng = random.Random(size)
    inner = [record(f"fake{i}", b"x" * rng.randrange(40)) for i in range(3)]
    tricks = [b"", b"\r\n\r\n", b"\r\n\r\nWARC/1.", b"\r\n\r\nWARC/1.1\r\nno length\r\n\r\n", b"WARC/1.0\r\n", b"\r\n\r\n\r\n\r\n",
              b"\xff\xfe\x00\r\n\r\nWARC/1.", b"\r\n\r\n" + b"".join(inner) + b"tail", b"".join(inner) * 4]
    want = []
    for n in range(2):
        data = b"".join(
            record(f"{n}-{i}", b"p" * rng.randrange(300) + rng.choice(tricks) + b"q" * rng.choice([0, 1, 500]))
            for i in range(30)
        )
        (tmp_path / f"a{n}.warc").write_bytes(data)
        want += [(f"a{n}.warc", *r) for r in sequential(data)]
    assert len(want) == 60 and any("fake" not in r[2] for r in want)
    splits(size)
    rows = read_warc(spark, str(tmp_path), contents=True).collect()
    assert sorted(
        (Path(r["file"]).name, r["offset"], r["headers"]["warc-record-id"], r["payload_bytes"], r["payload_digest"]) for r in rows
    ) == sorted(want)
    for r in rows:
        assert r["complete"] and base64.b32encode(hashlib.sha1(bytes(r["content"])).digest()).decode() == r["payload_digest"]


def test_chain_ends_where_an_archive_is_damaged(spark, tmp_path):
    (tmp_path / "cut.warc").write_bytes(record("a", b"1234") + record("b", b"x" * 90)[:-60])
    (tmp_path / "bad.warc").write_bytes(record("c", b"1") + b"WARC/1.0\r\nContent-Length: many\r\n\r\n\r\n\r\n" + record("d", b"2"))
    (tmp_path / "not.warc").write_bytes(b"nothing of the kind")
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["headers"]["warc-record-id"][7:-1], r["complete"]) for r in rows) == [("a", True), ("b", False), ("c", True)]


def pages_back(spark, df, path, **options):
    write_warc(df, path, **options)
    rows = read_warc(spark, path).collect()
    out = []
    for r in rows:
        h = r["headers"]
        page, refers = h["warc-record-id"], h.get("warc-refers-to")
        out.append((page[1:-1].removeprefix("urn:"), h["warc-type"], refers and refers[1:-1].removeprefix("urn:page:"), r["payload_bytes"], h.get("warc-target-uri")))
    return sorted(out, key=repr)


def test_responses_and_revisits(spark, tmp_path):
    schema = "page_id bigint, url string, html string, digest string, maybe int"
    rows = [(5, "u5", "same", "d", 1), (3, "u3", "same", "d", 1), (9, None, "same", "d", 1), (None, "u", "same", "d", 1),
            (3, "u3", "same", "d", 1), (7, "a\r\nb", None, None, None), (8, "", "", "x", 2), (None, "n", "alone", "x", 2),
            (11, "WARC/1.1", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "x", 0)]
    got = pages_back(spark, spark.createDataFrame(rows, schema), str(tmp_path / "a"))
    assert got == sorted([
        ("page:3", "response", None, 4, "u3"), ("page:3", "response", None, 4, "u3"), ("page:5", "revisit", "3", 4, "u5"),
        ("page:9", "revisit", "3", 4, None), ("nopage", "revisit", "3", 4, "u"), ("page:7", "response", None, 0, "a%0D%0Ab"),
        ("page:8", "revisit", "7", 0, ""), ("nopage", "response", None, 5, "n"), ("page:11", "response", None, 36, "WARC/1.1"),
    ], key=repr)
    least = pages_back(spark, spark.createDataFrame(rows, schema), str(tmp_path / "b"), least_bytes=5)
    assert {r[1] for r in least} == {"response"}
    assert pages_back(spark, spark.createDataFrame([], schema), str(tmp_path / "c")) == []


def test_large_group_of_equal_payloads_and_one_long_page(spark, splits, tmp_path):
    splits(1 << 16)
    rows = [(i, f"u{i}", "copy" if i % 3 else f"own {i}") for i in range(6000)] + [(-1, "long", (MAGIC + "\r\n\r\n") * 50_000)]
    got = pages_back(spark, spark.createDataFrame(rows, "page_id int, url string, html string"), str(tmp_path / "a"))
    assert len(got) == 6001
    assert sum(r[1] == "revisit" and r[2] == "1" for r in got) == 3999
    assert ("page%3A-1" not in str(got)) and ("page:-1", "response", None, 550_000, "long") in got
