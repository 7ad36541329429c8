import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from isobar.llm import catalog, warc

BODY = b"x" * 120
PAGES = [
    (5, "http://a/", BODY), (3, "http://b/ c\r\nX: y", BODY), (3, "http://b/", BODY), (9, None, BODY), (None, "http://n/", BODY),
    (1, "u", b"small"), (2, "u", b"small"), (7, "u", None), (8, "u", b""), (10, "u", b"y" * 100), (11, "u", b"y" * 100),
    (12, "u", b"z" * 99), (13, "u", b"z" * 99), (None, "u", b"q" * 100), (None, "v", b"q" * 100),
    (20, "u", b"\r\n\r\n" * 50), (21, "u", b"\r\n\r\n" * 25 + b"\r\n"), (22, "u", b"\r\n\r\r\n\r\nWARC/1.1\r\n\r\n" + b"\0" * 200),
    (23, "u", bytes(range(256))), (24, "u", b"\n" * 70000), (25, "u", b"a" * 65530 + b"\r\n\r\n\r"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "id bigint, uri string, payload binary")


def brute(rows):
    first = {}
    for i, _, payload in rows:
        if i is not None and len(payload or b"") >= 100:
            first[payload] = min(i, first.get(payload, i))
    out = []
    for i, _, payload in rows:
        payload = payload or b""
        told = first.get(payload)
        told = None if told == i else told
        kind = "response" if told is None else "revisit"
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), kind, told))
    return sorted(out, key=str)


def shown(found):
    rows = found.select(
        warc.page_of(F.col("id")).cast("bigint"), "payload_bytes", "payload_digest", "type",
        warc.page_of(F.col("refers_to")).cast("bigint"),
    )
    return sorted(map(tuple, rows.collect()), key=str)


def test_round_trip(spark, tmp_path):
    noise = random.Random(4)
    more = [(100 + i, f"http://h/{i}", noise.randbytes(noise.randrange(300))) for i in range(400)]
    assert shown(warc.round_trip(spark, frame(spark, PAGES + more), str(tmp_path))) == brute(PAGES + more)
    assert not (tmp_path / "whole").exists()


def test_members_index_and_fetch(spark, tmp_path):
    whole, out = tmp_path / "whole", tmp_path / "out"
    warc.write_monolithic(frame(spark).coalesce(1), str(whole))
    warc.normalise(spark, str(whole), str(out), archive_bytes=2000)
    streams = b"".join(gzip.decompress(p.read_bytes()) for p in whole.glob("*.gz"))
    archives = {p.parent.name.removeprefix("archive="): p.read_bytes() for p in out.glob("sidecar=false/*/*.txt")}
    assert len(archives) > 1 and sorted(streams.split(b"WARC/1.1")) == sorted(
        b"".join(gzip.decompress(a) for a in archives.values()).split(b"WARC/1.1")
    )
    index = warc.read_index(spark, str(out)).collect()
    assert len(index) == len(PAGES)
    for line in index:
        data = zlib.decompress(archives[line.archive][line.offset : line.offset + line.length], 31)
        assert data.startswith(b"WARC/1.1\r\n") and line.id.encode() in data and data.endswith(b"\r\n\r\n")
    ends = {}
    for line in sorted(index, key=lambda r: (r.archive, r.offset)):  # nothing between two members
        assert ends.get(line.archive, 0) == line.offset
        ends[line.archive] = line.offset + line.length
    assert ends == {name: len(a) for name, a in archives.items()}
    wanted = warc.read_index(spark, str(out)).where("type = 'response'")
    fetched = {r.id: r.payload for r in warc.fetch(spark, str(out), wanted).collect()}
    assert {hashlib.sha256(p).hexdigest() for p in fetched.values()} == {r.digest[7:] for r in index}
    read = warc.read_archives(spark, str(out), with_payload=True).where("type = 'response'")
    assert {r.id: r.payload for r in read.collect()} == fetched


def test_record_of_more_than_16_megabytes(spark, tmp_path):
    rows = [(1, "u", b"ab" * (9 << 20)), (2, "u", b"next")]
    assert shown(warc.round_trip(spark, frame(spark, rows).coalesce(1), str(tmp_path))) == brute(rows)
    index = warc.read_index(spark, str(tmp_path / "records"))
    assert warc.fetch(spark, str(tmp_path / "records"), index).where("payload_bytes IN (4, 18874368)").count() == 2


def record(kind, block, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n%s\r\n" % (kind, len(block), extra) + block + b"\r\n\r\n"


def test_foreign_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    info = record(b"warcinfo", b"software: x\r\n")
    page = record(b"response", b"HTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n", b"WARC-Record-ID: <urn:uuid:1>\r\n")
    (source / "a.warc.gz").write_bytes(gzip.compress(info + page) + gzip.compress(page))  # two members
    (source / "b.warc.gz").write_bytes(gzip.compress(page + b"\r\n\r\n"))  # more lines at the end
    (source / "c.warc.gz").write_bytes(gzip.compress(b""))
    (source / "notes.txt").write_text("no archive")
    warc.normalise(spark, str(source), str(tmp_path / "out"))
    read = warc.read_archives(spark, str(tmp_path / "out"), with_payload=True).collect()
    assert sorted((r.archive, r.type) for r in read) == [
        ("a-00000", "response"), ("a-00000", "response"), ("a-00000", "warcinfo"), ("b-00000", "response"),
    ]
    assert {bytes(r.payload) for r in read if r.type == "response"} == {b"hi\r\n\r\n"}


@pytest.mark.parametrize("bad", [b"HTTP/1.1 200 OK\r\n\r\nno archive", record(b"response", b"cut off")[:-9]])
def test_broken_streams_are_errors(spark, tmp_path, bad):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(bad))
    with pytest.raises(Exception, match="a: "):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_empty_table_and_other_columns(spark, tmp_path):
    assert shown(warc.round_trip(spark, frame(spark, []), str(tmp_path / "a"))) == []
    wide = frame(spark).selectExpr("*", "1 AS first", "2 AS digest", "3 AS _id", "4 AS payload_bytes", "5 AS value")
    assert shown(warc.round_trip(spark, wide, str(tmp_path / "b"))) == brute(PAGES)


def test_index_lines_are_json(spark, tmp_path):
    warc.round_trip(spark, frame(spark, PAGES[:2]), str(tmp_path))
    lines = b"".join(p.read_bytes() for p in Path(tmp_path).glob("records/sidecar=true/*/*.txt")).split(b"\0")[:-1]
    assert {json.loads(x)["type"] for x in lines} == {"response", "revisit"}


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_query_equals_sql(spark):
    mine = catalog.QUERIES["op13_warc"](spark, str(TESTDATA))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{TESTDATA}/pages.parquet'")
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({catalog.ORACLES['op13_warc']})").fetchall()
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, theirs))
