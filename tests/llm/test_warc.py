import base64
import gzip
import hashlib
import uuid
from pathlib import Path

import pytest

from reelframe.llm.warc import read_archive, record_table, write_archive, write_files

PAGES = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://b.example/\r\nX: y", None), (4, "u", ""), (5, "u", "É漢🙂\r\n\r\nWARC/1.1\r\n"),
         (6, "u%0A", "x" * 300_000), (7, "u", "x" * 300_000), (8, "u", "last"), (8, "u", "last"), (None, "n", "last"), (None, "n", "alone")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / uuid.uuid4().hex)
    write_archive(spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, address string, size int").repartition(3), path)
    return path


def expected():
    top = {}
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in PAGES:
        b, first = (h or "").encode(), top.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_records_read_back(spark, archive):
    df = record_table(read_archive(spark, archive))
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, df.collect()), key=repr) == expected()


def test_payloads_are_stored_once_and_urls_come_back(spark, archive):
    assert spark.read.parquet(archive + "/payloads").count() == len({h or "" for _, _, h in PAGES})
    rows = read_archive(spark, archive).collect()
    urls = sorted(((r.page_id, r.url) for r in rows), key=repr)
    assert urls == sorted(((i, u and u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in PAGES), key=repr)
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in PAGES)


def parse(blob):
    """Records of a WARC file by their stated lengths."""
    at, out = 0, []
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        lines = blob[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, blob[end + 4:end + 4 + n]))
        assert blob[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


def test_files_hold_whole_records(spark, archive, tmp_path):
    write_files(read_archive(spark, archive), str(tmp_path / "files"), records_per_file=4)
    records = [r for p in Path(tmp_path / "files").glob("*.gz") for r in parse(gzip.decompress(p.read_bytes()))]
    assert len(records) == len(PAGES)
    for fields, block in records:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        else:
            assert block == b"" and fields["WARC-Refers-To"].startswith("<urn:page:")


def test_small_payloads_can_stay_responses_and_changes_show(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    write_archive(pages, str(tmp_path / "a"), least_bytes=3)
    kinds = {r.page_id: r.record_type for r in read_archive(spark, str(tmp_path / "a")).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    store = spark.read.parquet(str(tmp_path / "a" / "payloads")).selectExpr("address", "cast('changed' as binary) payload", "first", "sha1")
    store.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="payload changed"):
        read_archive(spark, str(tmp_path / "b")).select("payload").collect()


def test_empty_table(spark, tmp_path):
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert record_table(read_archive(spark, str(tmp_path / "e"))).collect() == []
