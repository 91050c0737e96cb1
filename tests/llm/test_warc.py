import hashlib

import pytest

from sheetwise.llm import warc
from sheetwise.llm.common import shared_dir


def test_round_trip(spark):
    long = "<p>é日</p>" * 30
    pages = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (1, "u", "tiny"), (2, "u", "tiny"), (7, "u", None), (8, "u", ""), (3, "http://b", long), (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99)]
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string"), path)
    got = {(r.page_id, r.record_type): r for r in warc.read_archive(spark, path).collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    for i, _, html in pages:
        body = (html or "").encode()
        least = min(p for p, _, h in pages if (h or "") == (html or ""))
        revisit = len(body) >= 100 and i != least
        r = got[i, "revisit" if revisit else "response"]
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.verified) == (len(body), hashlib.sha256(body).hexdigest(), least if revisit else None, True)
    whole = {}
    for r in warc.reconstruct(spark, path).collect():
        whole.setdefault(r.page_id, []).append(r)
    assert sum(map(len, whole.values())) == len(pages)
    head, body = bytes(whole[11][0].record).split(b"\r\n\r\n", 1)
    assert body == b"y" * 100 + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nWARC-Date: 20" in head and b"WARC-Profile" not in head and b"Content-Length: 100" in head
    assert bytes(whole[12][0].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and bytes(whole[12][0].payload) == b"y" * 100
    assert warc.PROFILE.encode() in bytes(whole[12][0].record)
    heads = [bytes(r.record).split(b"\r\n\r\n")[0].decode().split("\r\n")[1:] for own in whole.values() for r in own]
    fields = [dict(line.split(": ", 1) for line in h) for h in heads]
    ids = [f["WARC-Record-ID"] for f in fields]
    kinds = dict(zip(ids, (f["WARC-Type"] for f in fields)))
    assert len(set(ids)) == len(ids)
    for f in fields:
        assert {"WARC-Date", "Content-Type", "Content-Length", "WARC-Target-URI"} <= set(f)
        assert f["WARC-Type"] == "response" or kinds[f["WARC-Refers-To"]] == "response" and f["WARC-Refers-To"].endswith(f["WARC-Payload-Digest"][7:] + ">")
    assert b"\r\nX: y" not in bytes(whole[3][0].record)


def test_empty(spark):
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []


def test_damage_is_seen(spark):
    path, other = shared_dir(spark), shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CASE WHEN payload = cast(repeat('a', 200) AS binary) THEN payload ELSE cast('bad' AS binary) END AS payload").write.parquet(f"{other}/payloads")
    assert {r.page_id: r.verified for r in warc.read_archive(spark, other, strict=False).collect()} == {1: True, 2: False}
    for read in (warc.read_archive, warc.reconstruct):
        with pytest.raises(Exception, match="damaged or missing payload"):
            read(spark, other).collect()


def test_repeats_nulls_and_a_long_page(spark):
    body = "<p>" + "é" * 2_000_000
    pages = [(1, "u", body), (1, "u", body), (1, "v", "z" * 200), (None, None, body), (2, "w", body), (2, "w", body)]
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, row int"), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_archive(spark, path).collect())
    n = len(body.encode())
    assert got == [(0, "revisit", 1, n), (1, "response", 0, 200), (1, "response", 0, n), (1, "response", 0, n), (2, "revisit", 1, n), (2, "revisit", 1, n)]
    ids = [bytes(r.record).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in warc.reconstruct(spark, path).collect()]
    assert len(set(ids)) == len(pages)
