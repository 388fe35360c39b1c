import glob
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wavemill.llm import warc
from wavemill.shared import kept, new_folder

SCHEMA = "page_id long, url string, html string, kind string, row long"
BIG = "x" * 1200
SEPARATOR = "\r\n\r\nWARC/1.1\r\n"
LINE = "\nWARC/1.1"
FAKE = SEPARATOR + "WARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc"


def brute(rows):
    alike = defaultdict(list)
    for r in rows:
        alike[r[2] or ""].append(r[0])
    out = []
    for text, ids in alike.items():
        payload = text.encode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(ids):
            again = n > 0 and len(payload) >= 1000
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in warc.inventory(warc.assemble(warc.read(spark, warc.archive(df)))).collect()), key=str)


def test_round_trip(spark):
    rows = [(1, "http://a.b/c\r\nX: y?z", None), (2, None, ""), (9, "v", "\r\n\r\n"), (10, "", f"a\r\n\r\n{BIG}\r\n\r\n"), (5, "u", "é" * 600), (6, "v", "é" * 600), (7, "v", "é" * 499), (8, "v", "é" * 499)]
    rows += [(i, "w", BIG) for i in range(100, 160)] + [(159, "w", BIG), (-5, "w", BIG), (None, "w", BIG), (13, "w", BIG + "\x00 "), (None, None, BIG + "2"), (None, None, BIG + "2")]
    rows += [(200, "long", "word ä\n" * 300_000), (201, "long", "word ä\n" * 300_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_payloads_that_hold_the_separator_or_records(spark):
    rows = [(3, "u", f"hello{FAKE}tail"), (4, "u", FAKE * 50 + BIG), (20, "q", FAKE), (21, "q", SEPARATOR), (22, "q", SEPARATOR * 2), (23, "q", "WARC/1.1\r\n"), (1, "q", "plain")]
    rows += [(30 + i, "q", f"{lead}{LINE}{tail}") for i, (lead, tail) in enumerate(((a, b) for a in ("", "x", "\r", "\r\n\r") for b in ("", "\r", "\r\n", "\r\n\r", "\r\n\r\n")))]
    assert run(spark, rows, 2) == run(spark, rows, 1) == brute(rows)


def test_separators_across_the_buffers_of_the_reader(spark):
    rows = [(i, f"http://h/{i}", "t" * (i * 37 % 4001)) for i in range(3000)]
    assert run(spark, rows, 1) == brute(rows)


def test_archives_of_several_splits(spark):
    path = new_folder(spark)
    rows = [(i, f"http://h/{i}", f"{i} " + "text " * (i % 700) + (FAKE if i % 50 == 0 else "")) for i in range(900)]
    warc.write(warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path, compression="none")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        read = warc.read(spark, path)
        assert read.rdd.getNumPartitions() > 3 and read.where("not whole").count() == 0
        assert sorted((tuple(r) for r in warc.inventory(warc.assemble(read)).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_records_are_as_the_format_says(spark):
    df = spark.createDataFrame([(1, "http://a.b/c d", BIG), (2, "http://a.b/e", BIG)], "page_id long, url string, html string")
    path = warc.archive(df.coalesce(1))
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(path.removeprefix("file:") + "/part*")))
    kinds, at = [], 0
    while at < len(raw):
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        kinds.append((fields["WARC-Type"], fields.get("WARC-Target-URI"), rest[:n].endswith(BIG.encode())))
        assert rest[n : n + 4] == b"\r\n\r\n"
        at += len(head) + 4 + n + 4
    assert sorted(kinds, key=str) == sorted([(k, None if k == "metadata" else u, k == "response") for u, k in (("http://a.b/c%20d", "request"), ("http://a.b/c%20d", "revisit"), ("http://a.b/c%20d", "metadata"), ("http://a.b/e", "request"), ("http://a.b/e", "response"), ("http://a.b/e", "metadata"))], key=str)


def records(spark, rows):
    df = spark.createDataFrame([(i, k, c) for i, k, c in rows], "record_id string, type string, concurrent_to array<string>")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("file", "date", "target_uri", "refers_to", "payload_digest", "content_type")], F.lit(b"HTTP/1.1 200 OK\r\n\r\nbody").alias("block"), F.lit(True).alias("whole"))


def test_links_in_both_directions_and_over_others(spark):
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1", "m1"]),  # the response names its request, metadata the request, and other metadata
        ("r2", "revisit", None), ("q2", "request", ["r2", "nowhere"]), ("m3", "metadata", ["r2", "r1"]),  # of two the smallest
        ("lost", "request", ["gone"]), ("l2", "metadata", ["lost"]), ("self", "metadata", ["self"]), ("w", "warcinfo", []),
    ]
    got = {r["record_id"]: r for r in warc.assemble(records(spark, rows)).collect()}
    names = lambda r, c: [x["record_id"] for x in r[c]]
    assert (names(got["r1"], "requests"), names(got["r1"], "metadata")) == (["q1"], ["m1", "m2", "m3"])
    assert (names(got["r2"], "requests"), names(got["r2"], "metadata")) == (["q2"], [])
    assert got["r1"]["response"]["payload"] == b"body" and set(got["lost"]["response"]) == {None}
    assert set(got) == {"r1", "r2", "lost", "l2", "self", "w"}


def test_files_cut_short(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nwarc-record-id: <urn:a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 50\r\n\r\nhel")
    got = warc.read(spark, f"file://{tmp_path}/a.warc").select("record_id", "block", "whole").orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("<urn:a>", b"hello", True), ("<urn:b>", b"hel", False)]


def test_payloads_that_nobody_asks_for_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    assembled = warc.assemble(warc.read(spark, warc.archive(df)))
    plan = lambda c: [x for x in assembled.select(c)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x or "_payload#" in x]
    caught = []
    monkeypatch.setattr(warc, "kept", lambda df: caught.append(df) or kept(df))
    warc.inventory(assembled)
    assert not any("_payload#" in x for x in caught[-1]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in x)
    assert not any("_payload#" in x for x in plan("response.payload_sha1")) and any("_payload#" in x for x in plan("response.payload"))


def test_one_nested_row_for_each_capture(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{BIG}{i % 3}") for i in range(9)], "page_id long, url string, html string")
    got = warc.assemble(warc.read(spark, warc.archive(df))).collect()
    assert len(got) == 9 and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)
    assert sorted(r["response"]["type"] for r in got) == ["response"] * 3 + ["revisit"] * 6
    assert {bytes(r["response"]["payload"]) for r in got} == {b"", *(f"{BIG}{i}".encode() for i in range(3))}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        path = warc.archive(df)
        warc.write(warc.captures(df), path)
