"""Legacy ARC archives turned into WARC.

``write_arc`` makes ARC files of versions 1 and 2 from a table, as a source. ``convert`` reads ARC files: the first
record of each declares the version and names the fields of all header lines after it, and each header line declares
its record's length. Every record becomes a WARC response, or a revisit where an equal payload is kept elsewhere;
identifiers, dates, types and digests are made from what the ARC line says and from the content. ``read_warc`` reads
the results back and takes the digest of every payload anew.

Payloads are never shuffled: archives are read where they are converted, and only digests, ids and places of records
are grouped. Files have names of their own in the shared folder and are found by a table of them that Spark writes, so
files left by lost or repeated tasks are never read. An archive ends after ``ARCHIVE_BYTES`` of records before compression
or after ``ARCHIVE_RECORDS`` of them, so that empty pages end one too.

Defined cases: a null html is an empty payload; a null url becomes "about:blank", and blanks in urls are escaped; a null
page_id stays null, and such a record is a response only if no equal payload has an id; of rows that repeat a page_id
and payload one is the response. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_dir, read_file, write_file

ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 1 << 16
# Fixed values of the ARC formats: the fields of a header line by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value of the WARC format: the profile of revisits by payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tidegrove/warc")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _pack(record: bytes) -> bytes:
    """One gzip member, as each record of a compressed archive is."""
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, body: bytes, offset: int, name: str) -> bytes:
    fields = [url, ip, date, kind] + (["200", "-", "-", str(offset), name] if version == 2 else []) + [str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> DataFrame:
    """Writes (page_id, url, html) as gzipped ARC files; returns (archive, records), a row a file. Odd and even
    partitions get different versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        parts, size, raw, name = [], 0, 0, ""

        def close():
            write_file(f"{folder}/{name}", parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(parts) - 1], pa.int64())], ["archive", "records"])

        for batch in batches:
            for key, url, html in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2).cast(pa.binary()), strict=True):
                if not parts:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    about = f"{version} 0 tidegrove\n{ARC_FIELDS[version]}\n".encode()
                    parts.append(_pack(_arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", about, 0, name)))
                    size, raw = len(parts[0]), 0
                payload = html.as_py() or b""
                where = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", (url.as_py() or b"about:blank").decode("utf-8", "replace"))
                own = "" if key.as_py() is None else f"X-Page-Id: {key.as_py()}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                parts.append(_pack(_arc_line(version, where, "0.0.0.0", date, "text/html", head + payload, size, name)))
                size += len(parts[-1])
                raw += len(head) + len(payload) + len(where)
                if raw >= ARCHIVE_BYTES or len(parts) > ARCHIVE_RECORDS:
                    yield close()
                    parts = []
        if parts:
            yield close()

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(rows.mapInArrow(run, "archive string, records bigint"), "arc-files")


def _open(uri: str) -> io.BufferedReader:
    raw = io.BufferedReader(read_file(uri), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def arc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and content of each record after the first, which describes the file."""
    names: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        if not names:
            size = int(line.rsplit(None, 1)[-1])
            about = stream.read(size).decode("utf-8", "replace").split("\n")
            version, names = about[0].split()[0], about[1].split()
            if ARC_FIELDS.get(int(version), "").split()[:4] != names[:4]:
                raise ValueError(f"unknown ARC version {about[0]!r}")
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} of {len(names)} fields")
        fields = dict(zip(names, values, strict=True))
        body = stream.read(int(fields["Archive-length"]))
        if len(body) != int(fields["Archive-length"]):
            raise ValueError("an ARC record is shorter than it says")
        yield fields, body


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return head + mark, payload, {k.strip().lower(): v.strip() for k, _, v in lines}


def _record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}/{digest}')}>"


def _spread(files: DataFrame) -> DataFrame:
    """A task for about each file: tables of files are too small for Spark to spread them by itself."""
    return files.repartition(max(1, files.count()), "archive")


def index_arc(files: DataFrame) -> DataFrame:
    """(archive, number, page_id, payload_bytes, payload_digest) of every ARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for number, (_, body) in enumerate(arc_records(_open(archive))):
                    _, payload, fields = _http(body)
                    rows.append((archive, number, int(fields["x-page-id"]) if "x-page-id" in fields else None, len(payload), base32_sha1(payload)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["archive", "number", "page_id", "payload_bytes", "payload_digest"])

    return _spread(files.select("archive")).mapInArrow(run, "archive string, number bigint, page_id bigint, payload_bytes bigint, payload_digest string")


def convert(files: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC file for each ARC file; returns (archive, records)."""
    index = cut(index_arc(files), "arc-index").where(F.col("payload_bytes") >= min_bytes)
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "number")
    heads = index.groupBy("payload_digest").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = index.join(heads, "payload_digest").where((F.col("archive") != F.col("head.archive")) | (F.col("number") != F.col("head.number")))
    lists = copies.groupBy("archive").agg(F.collect_list(F.struct("number", F.col("head.page_id").cast("string").alias("page"))).alias("copies"))  # an archive's own records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = {c["number"]: c["page"] or "" for c in copies or []}
                parts = [_pack(_warc("warcinfo", "<urn:uuid:%s>" % uuid.uuid5(_NAMESPACE, archive), "2000-01-01T00:00:00Z", "application/warc-fields", b"software: tidegrove\r\nformat: WARC File Format 1.1\r\n"))]
                for number, (arc, body) in enumerate(arc_records(_open(archive))):
                    parts.append(_pack(_from_arc(arc, body, target.get(number), f"{archive}/{number}", min_bytes)))
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                write_file(name, parts)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts) - 1], pa.int64())], ["archive", "records"])

    todo = _spread(files.select("archive").join(lists, "archive", "left").select("archive", "copies"))
    return cut(todo.mapInArrow(run, "archive string, records bigint"), "warc-files")


def _warc(kind: str, ident: str, date: str, content_type: str, block: bytes, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *more, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _from_arc(arc: dict[str, str], body: bytes, copy_of: str | None, place: str, min_bytes: int = 0) -> bytes:
    """The WARC record for an ARC record. copy_of: the page whose response holds the same payload; place: the record's
    archive and number, from which records that no revisit can refer to have their identifiers."""
    head, payload, fields = _http(body)
    d, digest, page = arc["Archive-date"].ljust(14, "0"), base32_sha1(payload), fields.get("x-page-id", "")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    more = [("WARC-Target-URI", arc["URL"]), ("WARC-IP-Address", arc["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if copy_of is None:
        own = _record_id(page, digest) if len(payload) >= min_bytes else f"<urn:uuid:{uuid.uuid5(_NAMESPACE, place)}>"
        return _warc("response", own, date, "application/http;msgtype=response", body, tuple(more))
    more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(copy_of, digest))]
    return _warc("revisit", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, place)}>", date, "application/http;msgtype=response", head, tuple(more))


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record begins here")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read_warc(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit; refers_to is the
    page of the response that a revisit names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for fields, block in warc_records(_open(archive)):
                    if base32_sha1(block) != fields["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError("a WARC block does not have its digest")
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _, payload, http = _http(block)
                    own = fields["warc-type"] == "response"
                    rows.append((int(http["x-page-id"]) if "x-page-id" in http else None, len(payload) if own else int(http["content-length"]), base32_sha1(payload) if own else fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "target"])

    rows = cut(_spread(files.select("archive")).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, target string"), "warc-index")
    heads = rows.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")).dropDuplicates(["target"])
    copies = rows.where("record_type = 'revisit'").join(heads, "target", "left")
    first = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return first.unionByName(copies).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC files and their conversion, as the WARC files hold them."""
    spark = pages.sparkSession
    return read_warc(convert(write_arc(pages, new_dir(spark, "arc")), new_dir(spark, "warc"), min_bytes))
