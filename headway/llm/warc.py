"""Web archives: legacy ARC files written, converted to WARC files, and these read again."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Bytes of an archive, about; a larger page has an archive of its own size.
ARCHIVE_BYTES = 32 << 20
#: Equal payloads of fewer bytes are each written in full.
LEAST_REVISIT = 0
#: The response header that carries a page's id.
PAGE_ID = "X-Page-Id"
#: When page 0 counts as captured; each further one is a second later.
FIRST_CAPTURE, CAPTURES = datetime(2001, 1, 1, tzinfo=UTC), 1_000_000_000

#: Fixed values of the ARC format: the fields of a record's line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed values of the WARC format.
WARC_VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARC_ROW = "path string, offset long, record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, payload_sha256 binary"
_WARC_ROW = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


class ArchiveError(ValueError):
    """An archive breaks its format; the message says where."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _opened(data: bytes) -> io.BufferedIOBase:
    return gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _taken(file: io.BufferedIOBase, n: int, where: str) -> bytes:
    """The next n bytes, however they look: lengths are declared, never searched for."""
    out = file.read(n)
    if len(out) < n:
        raise ArchiveError(f"{where}: {n} bytes are declared and {len(out)} left")
    return out


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """A response's head, with its empty line, and its payload.  What is no response is all payload."""
    end = block.find(b"\r\n\r\n") + 4
    return (block[:end], block[end:]) if block.startswith(b"HTTP/") and end > 3 else (b"", block)


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"^%s: (-?\d+)\r$" % PAGE_ID.encode(), head, re.MULTILINE)
    return int(found[1]) if found else None


# ARC


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, result: int, checksum: str, offset: int, name: str, length: int) -> bytes:
    middle = f" {result} {checksum} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def _arc_start(version: int, name: str) -> bytes:
    block = f"{version} 0 headway\n{ARC_FIELDS[version]}\n".encode()
    return _arc_line(version, f"filedesc://{name}", "0.0.0.0", f"{FIRST_CAPTURE:%Y%m%d%H%M%S}", "text/plain", 200, "-", 0, name, len(block)) + block + b"\n"


def _archive_url(url: str | None) -> str:
    """A url as one field of a line: white space and control characters escaped, - if there is none."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def _written(archives: DataFrame, folder: str) -> None:
    """Each row of archives, a column of bytes that end a line, as a file.  The text writer writes a value's bytes as they are, and ends it with the newline that is taken off here."""
    value = F.col("archive").substr(F.lit(1), F.octet_length("archive") - 1).cast("string").alias("value")
    archives.select(value).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(folder)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as ARC files, of version 1 and of version 2 by turns, each a file of about ``archive_bytes`` before compression.

    A page is an HTTP response whose payload is the html in UTF-8 (null:
    empty) and whose head carries the id; a null id has no such header, a null
    or empty url is -.  Each task writes what it scans, and holds one archive.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, version, name, out = TaskContext.get().partitionId(), 0, 0, "", bytearray()
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                payload = (html or "").encode()
                own = f"{PAGE_ID}: {page}\r\n" if page is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode() + payload
                if out and len(out) + len(block) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["archive"])
                    number, out = number + 1, bytearray()
                if not out:
                    version, name = 1 + (task + number) % 2, f"pages-{task:06d}-{number:06d}.arc"
                    out += _arc_start(version, name)
                date = FIRST_CAPTURE + timedelta(seconds=(page or 0) % CAPTURES)
                out += _arc_line(version, _archive_url(url), "0.0.0.0", f"{date:%Y%m%d%H%M%S}", "text/html", 200, digest(payload), len(out), name, len(block)) + block + b"\n"
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["archive"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    _written(rows.mapInArrow(run, "archive binary"), folder)


def parse_arc(data: bytes, path: str = "") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of an archive's records, the version block first, whose fields have Version beside those of its line.

    The version block says which fields a line has; the last is the block's length in all versions.
    """
    file = _opened(data)
    names, offset = None, 0
    while line := file.readline():
        if line.strip():
            where, values = f"{path}, byte {offset}", line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
            if not values[-1].isdigit():
                raise ArchiveError(f"{where}: no length in {line[:200]!r}")
            block = _taken(file, int(values[-1]), where)
            if names is None:
                version, *declared = block.decode().split("\n")
                number = version.split(" ")[0]
                if not values[0].startswith("filedesc://") or number not in ("1", "2") or not declared:
                    raise ArchiveError(f"{where}: no version block of version 1 or 2")
                names = declared[0].split()
                values, own = [values[0].removeprefix("filedesc://"), *values[1:]], {"Version": number}
            else:
                own = {}
            if len(values) != len(names):
                raise ArchiveError(f"{where}: {len(values)} fields, and {len(names)} declared")
            yield offset, dict(zip(names, values, strict=True)) | own, block
        offset = file.tell()


def _arc_info(name: str, offset: int, fields: dict[str, str], block: bytes, where: str) -> dict:
    """What a WARC record says of an ARC record: identifier, time, type, and the payload with its digest."""
    date = fields["Archive-date"]
    if not re.fullmatch(r"\d{14}", date):
        raise ArchiveError(f"{where}, byte {offset}: no date in {date!r}")
    head, payload = _split_http(block)
    own = digest(payload)
    if fields.get("Checksum", "-") not in ("-", own):
        raise ArchiveError(f"{where}, byte {offset}: the payload's digest is not the declared one")
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}", "record_type": "response" if head else "resource", "url": None if fields["URL"] == "-" else fields["URL"],
        "date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z", "head": head, "payload": payload, "payload_digest": own,
    }


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, offset, record_id, record_type, url, date, page_id, payload_bytes, payload_digest, payload_sha256) of all records in folder's ARC files, with the identifiers that they have as WARC records."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        name = ""
        for offset, fields, block in parse_arc(data, path):
            if "Version" in fields:
                name = fields["URL"]
                continue
            x = _arc_info(name, offset, fields, block, path)
            yield path, offset, x["record_id"], x["record_type"], x["url"], x["date"], _page_id(x["head"]), len(x["payload"]), x["payload_digest"], hashlib.sha256(x["payload"]).digest()

    return _read(spark, folder, rows, _ARC_ROW)


def _read(spark: SparkSession, folder: str, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """rows(path, data) of each file in folder, a file at a time."""
    small_batches(spark)
    kind = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                found = list(rows(path.as_py(), data.as_py()))
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in found], kind)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)


# WARC


def _warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return WARC_VERSION + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def _converted(path: str, data: bytes, revisits: dict[int, dict]) -> bytes:
    """An ARC file as a WARC file; revisits has, by offset, the records whose payload another record holds."""
    out, name = bytearray(), ""
    for offset, fields, block in parse_arc(data, path):
        x = _arc_info(fields["URL"] if "Version" in fields else name, offset, fields, block, path)
        who = [("WARC-Record-ID", f"<{x['record_id']}>"), ("WARC-Date", x["date"])]
        if "Version" in fields:
            name = fields["URL"]
            info = f"software: headway\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name}, ARC version {fields['Version']}\r\n".encode()
            out += _warc_record([("WARC-Type", "warcinfo"), *who, ("WARC-Filename", name.removesuffix(".arc") + ".warc.gz"), ("Content-Type", "application/warc-fields")], info)
            continue
        other = revisits.get(offset)
        body = x["head"] if other else block
        ip = fields["IP-address"]
        out += _warc_record(
            [
                ("WARC-Type", "revisit" if other else x["record_type"]), *who, ("WARC-Target-URI", x["url"]), ("WARC-IP-Address", None if ip == "0.0.0.0" else ip),
                ("WARC-Payload-Digest", f"sha1:{x['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{digest(body)}"),
                *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{other['record_id']}>"), ("WARC-Refers-To-Target-URI", other["url"]), ("WARC-Refers-To-Date", other["date"])] if other else []),
                ("Content-Type", "application/http; msgtype=response" if x["head"] else fields["Content-type"]),
            ],
            body,
        )
    return bytes(out)


def revisits_of(index: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """(path, offset, record_id, url, date): the records of an arc_index that are written as revisits, and the record that each refers to.

    Of records with equal payloads of at least ``least_bytes`` the one with
    the largest page id is written in full (ids that are null come last, ties
    go to the largest record id).  Index rows and groups are written tables,
    so that Spark can split a large group in the join.
    """
    scratch = Scratch(index.sparkSession, "revisits")
    index = index.filter((F.col("payload_bytes") >= least_bytes) & (F.col("record_type") == "response"))
    groups = index.groupBy("payload_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("page_id", "record_id", "url", "date")).alias("held"))
    groups = scratch.write(groups.filter("rows > 1"))
    return index.select("payload_sha256", "path", "offset", F.col("record_id").alias("own")).join(groups, "payload_sha256").filter("own <> held.record_id").select("path", "offset", "held.record_id", "held.url", "held.date")


def arc_to_warc(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = LEAST_REVISIT) -> None:
    """Convert each ARC file of a folder to a WARC file.

    A first pass indexes the records, and tells which are revisits; a second
    writes each archive with its own list of these.  Compressed archives go
    through the join, never payloads of the whole folder; a task holds one
    archive.
    """
    scratch = Scratch(spark, "arc-index")
    index = scratch.write(arc_index(spark, arc_folder))
    lists = revisits_of(index, least_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", "record_id", "url", "date")).alias("revisits"))
    files = spark.read.format("binaryFile").load(arc_folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, revisits in zip(*(batch.column(c) for c in ("path", "content", "revisits")), strict=True):
                if out := _converted(path.as_py(), data.as_py(), {r["offset"]: r for r in revisits.as_py() or []}):
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["archive"])

    _written(files.join(lists, "path", "left").select("path", "content", "revisits").mapInArrow(run, "archive binary"), warc_folder)


def parse_warc(data: bytes, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a WARC file's records; header names are lower-cased."""
    file = _opened(data)
    while line := file.readline():
        where = f"{path}, byte {file.tell() - len(line)}"
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
            raise ArchiveError(f"{where}: {line[:200]!r} begins no record")
        headers = {}
        while (line := file.readline()).strip():
            key, colon, value = line.decode("utf-8", "surrogateescape").partition(":")
            if not colon:
                raise ArchiveError(f"{where}: {line[:200]!r} is no header")
            headers[key.strip().lower()] = value.strip(" \t\r\n")
        if not headers.get("content-length", "").isdigit():
            raise ArchiveError(f"{where}: no length")
        block = _taken(file, int(headers["content-length"]), where)
        if _taken(file, 4, where) != b"\r\n\r\n":
            raise ArchiveError(f"{where}: the record doesn't end where its length says")
        yield headers, block


def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to_id) of all records in folder's WARC files but warcinfo.

    Digests are compared with the blocks and payloads there; a revisit's
    payload_digest is its header's, its payload_bytes null.
    """

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for headers, block in parse_warc(data, path):
            if headers["warc-type"] == "warcinfo":
                continue
            head, payload = _split_http(block)
            revisit, own = headers["warc-type"] == "revisit", headers["warc-payload-digest"].removeprefix("sha1:")
            if headers["warc-block-digest"] != f"sha1:{digest(block)}" or not revisit and own != digest(payload):
                raise ArchiveError(f"{path}: the digest of {headers['warc-record-id']} is wrong")
            yield headers["warc-record-id"].strip("<>"), headers["warc-type"], headers.get("warc-target-uri"), headers["warc-date"], _page_id(head), None if revisit else len(payload), own, headers["warc-refers-to"].strip("<>") if revisit else None

    return _read(spark, folder, rows, _WARC_ROW)


def resolved(records: DataFrame) -> DataFrame:
    """records with payload_bytes also of revisits, and refers_to, the page id of the record that a revisit refers to (null otherwise)."""
    scratch = Scratch(records.sparkSession, "warc-records")
    records = scratch.write(records)
    revisits, held = records.filter("refers_to_id is not null"), records.filter("refers_to_id is null")
    target = held.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("held_bytes"))
    found = revisits.join(target, "refers_to_id").withColumn("payload_bytes", F.col("held_bytes")).drop("held_bytes")
    return held.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op12_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "archives").root
    write_arc(table(spark, sf_dir, "pages"), f"{root}/arc")
    arc_to_warc(spark, f"{root}/arc", f"{root}/warc")
    return resolved(warc_records(spark, f"{root}/warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * group + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for group in range(8) for shift in (15, 10, 5, 0)
)
QUERIES = {"op12_warc_convert": op12_warc_convert}
ORACLE_SQL = {
    "op12_warc_convert": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
t AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN t USING (hex)""",
}
