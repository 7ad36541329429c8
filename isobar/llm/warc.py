"""WARC archives: records written, whole-file streams made record-wise with an offset index, and read."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard

#: Ends the headers of a record or of a message, and ends a record.
BLANK = "\r\n\r\n"
_END = BLANK.encode()
#: Bytes after which the next record begins another archive, as archive writers do.
ARCHIVE_BYTES = 32 << 20
#: Payloads from here on are stored once.
SHARED_FROM = 100
#: Archive bytes that are inflated at a time while records are cut.
_FEED = 1 << 14
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def prepared(pages: DataFrame, shared_from: int = SHARED_FROM) -> DataFrame:
    """``id, uri, payload, payload_bytes, digest, first``: ``first`` is null for a response.

    ``pages`` has ``id, uri, payload`` (binary; null counts as empty).  Of records with
    equal payloads of ``shared_from`` bytes or more, those with the smallest id are
    responses and the others name it; records without an id never are the smallest,
    and are responses where no equal one has an id.  Rows that repeat an id and a
    payload share their answer.  First ids are found on ids and digests alone; payloads
    move once, by id and digest, so an often repeated payload lies in no one task.
    """
    whole = pages.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("digest")
    )
    small = whole.where(F.col("payload_bytes") >= shared_from).select("id", "digest").distinct()
    first = small.groupBy("digest").agg(F.min("id").alias("first"))
    later = small.join(first, "digest").where("first IS NOT NULL AND NOT id <=> first")
    later = later.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first")
    same = whole["id"].eqNullSafe(later["_id"]) & (whole["digest"] == later["_digest"])
    return whole.join(later, same, "left").drop("_id", "_digest")


def _name(id_: Column, digest: Column) -> Column:
    """Record ids say which page and payload they stand for, so that equal rows make equal records."""
    page = F.coalesce(F.url_encode(id_.cast("string")), F.lit(""))
    return F.concat(F.lit("<urn:page:"), page, F.lit(":"), digest, F.lit(">"))


def record(date: str) -> Column:
    """A record of ``prepared`` columns as bytes, without the blank lines that end it."""
    uri = F.coalesce(F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    message = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "payload_bytes", F.lit(BLANK)
    )
    told = F.col("first").isNotNull()
    size = F.length(message) + F.when(told, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(told, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("id"), F.col("digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(
            told, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _name(F.col("first"), F.col("digest")))
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size, F.lit(BLANK),
    )
    return F.concat(F.encode(F.concat(head, message), "UTF-8"), F.when(told, F.lit(b"")).otherwise(F.col("payload")))


def write_monolithic(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", shared_from: int = SHARED_FROM) -> None:
    """One gzip stream a task: records, each ended by two line ends, under one compression.

    The engine's text writer with that ending as its line separator writes just this,
    and commits a task's file only once however often the task is run.
    """
    rows = prepared(pages, shared_from).select(record(date).cast("string").alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", BLANK).text(folder)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    parted = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in parted}


def _cut(buffer: bytearray, file: str, last: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Whole records at the front of the stream, with their headers; what is left stays in it."""
    at = 0
    while True:
        while buffer[at : at + 2] == b"\r\n":  # some writers end a file or a record with more lines
            at += 2
        end = buffer.find(_END, at)
        if end < 0:
            break
        if not buffer.startswith(b"WARC/", at):
            raise ValueError(f"{file}: no record where one should begin")
        fields = _fields(bytes(buffer[at:end]))
        stop = end + 4 + int(fields["content-length"])
        if len(buffer) < stop + (0 if last else 4):
            break
        yield fields, bytes(buffer[at:stop])
        at = stop
    del buffer[:at]
    if last and buffer.strip():
        raise ValueError(f"{file}: the last record is cut off")


def normalise(spark: SparkSession, source: str, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> None:
    """Rewrites whole-file gzip streams so that every record is a gzip member of its own.

    ``source`` holds ``.gz`` files, each one compressed stream (or several) of WARC
    records.  ``folder/sidecar=false/archive=NAME`` gets the members, one after the
    other and nothing between; ``folder/sidecar=true/archive=NAME`` gets one JSON
    object per record with ``offset``, ``length``, ``type``, ``id``, ``uri``,
    ``digest``, ``refers_to``, each ended by a zero byte.  An input of any size becomes
    archives of about ``archive_bytes``, named after it and counted.  An empty folder
    gives no archives; an input that breaks off or holds anything else raises an error.

    The engine's text reader inflates each stream once, cut at blank lines; joined by
    them again, the pieces are the stream, from which records are cut by their stated
    lengths.  A task holds one record, not a file.  The length that ends a member has a
    zero as its last byte (below 16 MB a record; a longer one is followed by an empty
    member), and that zero is the writer's line separator.
    """

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"sidecar": [], "archive": [], "at": [], "value": []}
        held = number = offset = 0
        buffer, now = bytearray(), None

        def members(last: bool) -> None:
            nonlocal held, number, offset
            for fields, data in _cut(buffer, now, last):
                if offset >= archive_bytes:
                    number, offset = number + 1, 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(data + _END) + packer.flush()
                line = {
                    "offset": offset, "length": len(member), "type": fields.get("warc-type"),
                    "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
                    "digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to"),
                }
                if member[-1]:
                    member += _EMPTY_MEMBER
                for sidecar, value in ((False, member[:-1]), (True, json.dumps(line).encode())):
                    out["sidecar"].append(sidecar)
                    out["archive"].append(f"{now}-{number:05d}")
                    out["at"].append(offset)
                    out["value"].append(value)
                held += len(member)
                offset += len(member)

        def flushed() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_pydict(out, schema=_WRITTEN)
            for column in out.values():
                column.clear()
            held = 0
            return batch

        for batch in batches:
            for file, piece in zip(batch["file"].to_pylist(), batch["piece"], strict=True):
                if file != now:
                    if now is not None:
                        members(last=True)
                    now, number, offset = file, 0, 0
                    buffer.clear()
                buffer += piece.as_buffer()
                buffer += _END
                if len(buffer) >= 1 << 20:
                    members(last=False)
                if held >= 4 << 20:
                    yield flushed()
        if now is not None:
            members(last=True)
        yield flushed()

    text = spark.read.option("lineSep", BLANK).option("pathGlobFilter", "*.gz").text(source)
    pieces = text.select(
        F.regexp_replace("_metadata.file_name", r"(\.warc|\.txt)?\.gz$", "").alias("file"), F.col("value").cast("binary").alias("piece")
    )
    cut = pieces.mapInArrow(rewritten, "sidecar boolean, archive string, at bigint, value binary")
    ordered = cut.sortWithinPartitions("sidecar", "archive", "at")
    ordered.select("sidecar", "archive", F.col("value").cast("string").alias("value")).write.partitionBy(
        "sidecar", "archive"
    ).option("compression", "none").option("lineSep", "\0").text(folder)


_WRITTEN = pa.schema([("sidecar", pa.bool_()), ("archive", pa.string()), ("at", pa.int64()), ("value", pa.binary())])
_INDEX = "offset bigint, length bigint, type string, id string, uri string, digest string, refers_to string"
_READ = f"archive string, {_INDEX}, payload_bytes bigint, payload_digest string, payload binary"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``archive`` and the fields of every line of the sidecar index of ``normalise``."""
    lines = spark.read.option("lineSep", "\0").schema("value string, sidecar string, archive string").text(folder).where("sidecar = 'true'")
    return lines.select("archive", F.from_json("value", _INDEX).alias("f")).select("archive", "f.*")


def _members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and inflated bytes of every member of an archive."""
    at = 0
    while at < len(content):
        unpacker, parts, end = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if end >= len(content):
                raise ValueError("the last member is cut off")
            parts.append(unpacker.decompress(content[end : end + _FEED]))
            end = min(end + _FEED, len(content))
        end -= len(unpacker.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


def _parsed(data: bytes, with_payload: bool) -> dict:
    """What a record says of itself, and of its payload what its bytes say."""
    head = data.find(_END)
    fields = _fields(data[:head])
    block = data[head + 4 : head + 4 + int(fields["content-length"])]
    message = block.find(_END)
    payload = block[message + 4 :]
    said = {
        "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to"),
    }
    if fields.get("warc-type") == "revisit":
        length = int(_fields(block[:message])["content-length"])
        return said | {"payload_bytes": length, "payload_digest": fields["warc-payload-digest"].partition(":")[2]}
    kept = {"payload": payload} if with_payload else {}
    return said | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()} | kept


def _record_rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=_RECORDS)


_RECORDS = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [(c, pa.string()) for c in ("type", "id", "uri", "digest", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives of ``normalise``: its place, its fields, and its payload's length and digest.

    Length and digest of a response are taken from the bytes read; those of a revisit
    are what it states of the payload it refers to.  ``payload`` is null unless asked
    for, and for revisits.  An archive is read whole, so memory follows
    ``archive_bytes`` of ``normalise``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch["archive"].to_pylist(), batch["content"], strict=True):
                found, held = [], 0
                for offset, length, data in _members(memoryview(content.as_buffer())):
                    found.append({"archive": archive, "offset": offset, "length": length} | _parsed(data, with_payload))
                    held += len(data) if with_payload else 500
                    if held >= 4 << 20:
                        yield _record_rows(found)
                        found, held = [], 0
                yield _record_rows(found)

    return _files(spark, folder).mapInArrow(read, _READ)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    archives = files.where(F.col("_metadata.file_path").contains("/sidecar=false/"))
    return archives.select(F.regexp_extract("path", "/archive=([^/]*)/", 1).alias("archive"), "content")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Chosen records by their place: ``wanted`` has ``archive, offset, length`` rows of the index.

    Archives without a wanted record are not kept; of the others only the wanted
    members are inflated.
    """

    def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length", "member")), strict=True)
            found = [
                {"archive": a, "offset": o, "length": n} | _parsed(zlib.decompress(m, 31), True) for a, o, n, m in rows
            ]
            yield _record_rows(found)

    member = F.expr("substring(content, cast(offset + 1 AS int), cast(length AS int))")
    places = wanted.select("archive", "offset", "length").distinct()
    cut = _files(spark, folder).join(places, "archive").select("archive", "offset", "length", member.alias("member"))
    return cut.mapInArrow(inflated, _READ)


def page_of(name: Column) -> Column:
    """The page id that a record's name holds, null for none."""
    inner = F.regexp_extract(name, "^<urn:page:([^:]*):", 1)
    return F.nullif(F.url_decode(inner), F.lit(""))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (``id, uri, payload``) as archives below ``folder`` and reads them back.

    ``folder/whole`` holds the whole-file streams until they are normalised,
    ``folder/records`` the archives and their index.  An empty table gives no rows.
    """
    write_monolithic(pages, f"{folder}/whole")
    normalise(spark, f"{folder}/whole", f"{folder}/records")
    discard(spark, f"{folder}/whole")
    return read_archives(spark, f"{folder}/records")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS bigint) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
