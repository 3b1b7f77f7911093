"""WARC archives: bounded files, members, repeated fields and damage."""

import gzip
import hashlib

from pyspark.sql import functions as F

from marginalia.llm import warc


def record(kind, name, block, **fields):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"{k.replace('_', '-')}: {v}" for k, many in fields.items() for v in ([many] if isinstance(many, str) else many)), f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\n"


def test_members_and_repeated_fields(spark, tmp_path):
    parts = [
        record("warcinfo", "i", b"x: y"), record("response", "r1", HTTP + b"<p>one</p>"), record("response", "r2", HTTP + b""),
        record("request", "q", b"GET /", WARC_Concurrent_To=["<r1>", "<r2>"]), record("metadata", "m", b"a: b\r\nbare", WARC_Concurrent_To="<r2>"), record("metadata", "lost", b"", WARC_Concurrent_To="<none>")]
    for name, data in (("each.warc.gz", b"".join(map(gzip.compress, parts))), ("whole.warc.gz", gzip.compress(b"".join(parts))), ("plain.warc", b"".join(parts))):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        got = {r["record_id"]: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path / name))).collect()}
        assert got.keys() == {"<r1>", "<r2>"} and got["<r1>"]["request"]["record_id"] == got["<r2>"]["request"]["record_id"] == "<q>"
        assert got["<r1>"]["metadata"] is None and got["<r2>"]["metadata"]["fields"] == {"a": "b"} and got["<r1>"]["response"]["payload"] == b"<p>one</p>" and got["<r2>"]["response"]["payload_bytes"] == 0


def test_damage_is_told_and_the_rest_kept(spark, tmp_path):
    good = record("response", "r1", HTTP + b"kept")
    bad = {"cut": gzip.compress(good * 2)[:-9], "junk": good + b"junk\r\n\r\n", "length": good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", "binary": b"\x1f\x8b\x00\x00", "digest": record("response", "d", HTTP + b"x", WARC_Payload_Digest="sha256:00"), "empty": b""}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sum(r["kind"] == "damaged" for r in rows) == 5 and sum(r["payload"] == b"kept" for r in rows) >= 3
    assert warc.assemble(warc.read_archives(spark, str(tmp_path))).filter("response.kind = 'damaged'").count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    pages = spark.createDataFrame([(i, "http://a", "ä" * 5_000 + str(i)) for i in range(40)] + [(100, "u", "z" * 200_000)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 30 and sorted(sizes)[-2] < 60_000
    got = {r["page_id"]: r["payload_digest"] for r in warc.warc_captures(pages.withColumn("record_type", F.lit(1))).collect()}
    assert got[100] == hashlib.sha256(b"z" * 200_000).hexdigest() and len(got) == 41
