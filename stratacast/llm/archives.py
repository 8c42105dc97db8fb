"""Legacy archive converter: ARC (versions 1 and 2) to WARC, and back to rows.

An ARC file opens with a ``filedesc`` record whose body names the version and
the fields of each later header line; the last field is the declared length of
the body.  The converter reads header lines by those fields, takes bodies by
their declared lengths and makes the WARC record that stands for each: an
identifier derived from what the record holds, the date, a type and digests.

WARC files are written by Spark's own text writer (the bytes of a file are one
line), hence through its commit protocol and to any file system that Spark
writes to; a lost executor leaves no half-written archive behind.  One row is
one file of about ``FILE_BYTES``, in which every record is a gzip member of its
own, as readers that seek to a record expect.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, checkpointed, discard, read_table, scratch_path, small_batches, spooled, written

FILE_BYTES = 8 << 20
#: Header-line fields of both versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NO_URL = "about:blank"
#: For tables of archives and of records: Parquet else gathers 100 rows at least in a row group, which writers and readers hold whole.
ARCHIVE_GROUPS = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False}
RECORD_GROUPS = {"parquet.block.size": FILE_BYTES, "parquet.page.size.row.check.min": 1, "compression": "zstd"}
CRLF = b"\r\n"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes
    #: Name of the file and the byte at which the record starts.
    place: tuple[str, int] = ("", 0)
    #: Whether it is the record that opens the file, whatever its URL looks like.
    opens: bool = False


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def arc_bytes(pages: Iterable[tuple[str | None, str | None, bytes]], version: int, name: str, date: str = "20000101000000") -> bytes:
    """An ARC file of HTTP responses; a page is its id (a header of the response), URL and payload."""
    intro = f"{version} 0 stratacast\n{FIELDS[version]}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "text/plain", len(intro), 0, name, date), intro, b"\n"]
    at = sum(map(len, out))
    for page_id, url, payload in pages:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
        if page_id is not None:
            head += b"X-Page-Id: %s\r\n" % str(page_id).encode()
        body = head + CRLF + payload
        line = _arc_line(version, re.sub(r"\s", "%20", url) if url else NO_URL, "text/html", len(body), at, name, date)
        out += [line, body, b"\n"]
        at += len(line) + len(body) + 1
    return b"".join(out)


def _arc_line(version: int, url: str, kind: str, length: int, offset: int, name: str, date: str) -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {kind}{middle} {length}\n".encode("utf-8", "surrogatepass")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, ``filedesc`` first; a body that ends early is cut where the file ends."""
    at, names, file = 0, None, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no ARC header line at byte {at}")
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r")
        length = line.rpartition(" ")[2]
        if not length.isdecimal():
            raise ValueError(f"no declared length in the ARC header line at byte {at}")
        body = data[end + 1 : end + 1 + int(length)]
        opens = names is None
        if names is None:
            file = line.split(" ")[0].removeprefix("filedesc://")
            intro = body.decode("utf-8", "replace").split("\n")
            version = int(intro[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = (intro[1] if len(intro) > 1 and intro[1].startswith("URL ") else FIELDS[version]).split(" ")
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"{len(values)} of {len(names)} fields in the ARC header line at byte {at}")
        yield ArcRecord(dict(zip(names, values, strict=True)), body, (file, at), opens)
        at = end + 1 + int(length) + 1


def warc_date(stamp: str) -> str:
    """ISO 8601 of an ARC date of 14 digits, or of the first 4 to 12 of them."""
    digits = (re.match(r"\d{4,14}", stamp) or re.match("", "")).group()
    full = digits + "00000101000000"[len(digits) :] if digits else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def convert(record: ArcRecord) -> WarcRecord:
    """The WARC record of an ARC record; its identifier is a function of its place, URL, date and body."""
    url, date = record.fields["URL"], warc_date(record.fields["Archive-date"])
    headers = {
        "WARC-Type": "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.place} {url} {date} {base32_sha1(record.body)}')}>",
        "WARC-Date": date,
    }
    if record.opens:
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": record.place[0], "Content-Type": "application/warc-fields"}
        return WarcRecord(headers, b"software: stratacast\r\nformat: WARC File Format 1.1\r\n")
    headers |= {"WARC-Target-URI": url, "WARC-IP-Address": record.fields["IP-address"], "WARC-Block-Digest": f"sha1:{base32_sha1(record.body)}"}
    if not record.body.startswith(b"HTTP/"):
        return WarcRecord(headers | {"Content-Type": record.fields["Content-type"]}, record.body)
    payload = record.body.partition(CRLF + CRLF)[2]
    headers |= {"WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
    return WarcRecord(headers, record.body)


def revisit(record: WarcRecord, of: str) -> WarcRecord:
    """``record`` without its payload, referring to the record ``of`` with the same payload."""
    head = record.block.partition(CRLF + CRLF)[0] + CRLF + CRLF
    headers = record.headers | {
        "WARC-Type": "revisit",
        "WARC-Refers-To": of,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Block-Digest": f"sha1:{base32_sha1(head)}",
    }
    return WarcRecord(headers, head)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in record.headers.items()]
    return CRLF.join([*lines, b"Content-Length: %d" % len(record.block), b"", record.block, b"", b""])


def packed(record: bytes) -> bytes:
    """A gzip member."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members in turn, fed in small pieces, as what is left of a piece is copied for each member."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            piece = view[at : at + (1 << 14)]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(out)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, plain or gzipped, by their declared lengths; of a gzipped file a record's members are unpacked at once, not the whole."""
    parts = unpacked(data) if data[:2] == b"\x1f\x8b" else iter([data])
    held, passed, ended = b"", 0, False
    while not ended:
        part = next(parts, None)
        ended, held, at = part is None, held + (part or b""), 0
        while at < len(held):
            if held.startswith(CRLF, at):
                at += 2
                continue
            end = held.find(CRLF + CRLF, at)
            if end < 0 and not ended:
                break
            lines = held[at:end].split(CRLF)
            if end < 0 or not lines[0].startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {passed + at}")
            headers = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines[1:])
            length = int(headers.pop("Content-Length"))
            if end + 4 + length > len(held) and not ended:
                break
            yield WarcRecord(headers, held[end + 4 : end + 4 + length])
            at = end + 4 + length
        held, passed = held[at:], passed + at


def http_header(block: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^%s: *([^\r\n]*)" % re.escape(name), block.partition(CRLF + CRLF)[0])
    return found[1].decode() if found else None


CONVERTED = "page_id long, record_id string, digest string, payload_bytes long, headers map<string,string>, block binary"


def arc_files(pages: DataFrame, id_col: str, url_col: str, html_col: str, version: int | None = None) -> DataFrame:
    """``(arc binary)``: pages as legacy archives of about ``FILE_BYTES``, of both versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            data = arc_bytes(held, version or 1 + n % 2, f"pages-{task.partitionId() if task else 0:05d}-{n:05d}.arc")
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["arc"])

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((page_id, url, html or b""))
                size += len(html or b"") + 300
                if size >= FILE_BYTES:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("html")
    ).mapInArrow(spooled(run), "arc binary")


def converted(arcs: DataFrame) -> DataFrame:
    """The WARC records of ARC files as rows: what describes them, their headers and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column(0):
                rows, size = [], 0
                for record in map(convert, read_arc(arc.as_py())):
                    if record.headers["WARC-Type"] == "warcinfo":
                        continue
                    page_id = http_header(record.block, b"X-Page-Id")
                    payload = len(record.block.partition(CRLF + CRLF)[2])
                    rows.append((page_id, record.headers["WARC-Record-ID"], record.headers.get("WARC-Payload-Digest"), payload, record))
                    size += payload
                    if size > FILE_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list) -> pa.RecordBatch:
        cols = [pa.array([None if r[0] is None else int(r[0]) for r in rows], pa.int64())]
        cols += [pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.string()), (2, pa.string()), (3, pa.int64()))]
        cols.append(pa.array([list(r[4].headers.items()) for r in rows], pa.map_(pa.string(), pa.string())))
        cols.append(pa.array([r[4].block for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=["page_id", "record_id", "digest", "payload_bytes", "headers", "block"])

    return arcs.mapInArrow(spooled(run), CONVERTED)


def write_warcs(records: DataFrame, path: str, gzipped: bool) -> None:
    """Write ``(headers, block, refers_to_id)`` rows as WARC files, revisits where ``refers_to_id`` is set."""
    # what any file ends with: the length of the last member, low byte first, or the last empty line
    line_end = b"\0" if gzipped else CRLF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packed if gzipped else bytes
        info = pack(warc_bytes(convert(next(read_arc(arc_bytes([], 1, "stratacast.arc"))))))
        held, size = [info], 0

        def flush() -> pa.RecordBatch:
            data = b"".join(held)
            if gzipped and data[-1:] != b"\0":  # a last record of 16 MB or more: end with an empty member
                data += packed(b"")
            data = data[: -len(line_end)]  # which the writer puts there again
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            for headers, block, of in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                record = WarcRecord(dict(headers.as_py()), block.as_py())
                held.append(pack(warc_bytes(record if of is None else revisit(record, of))))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size = [info], 0
        if len(held) > 1:
            yield flush()

    files = records.select("headers", "block", "refers_to_id").mapInArrow(spooled(run), "value binary")
    lines = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    lines.option("lineSep", line_end.decode()).option("compression", "none").text(path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """What the archives below ``path`` hold: ``page_id, record_id, record_type, refers_to_id, payload_bytes, payload_digest``.

    Length and digest of a response are those of the payload that was read, and a
    payload that its record's digest does not fit is an error.  A revisit has no
    payload; its row has what its headers declare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_warc(content.as_py()):
                    if r.headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    page_id, declared = http_header(r.block, b"X-Page-Id"), r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length, digest = int(http_header(r.block, b"Content-Length") or 0), declared
                    if r.headers["WARC-Type"] == "response":
                        payload = r.block.partition(CRLF + CRLF)[2]
                        length, digest = len(payload), base32_sha1(payload)
                        if digest != declared:
                            raise ValueError(f"{r.headers['WARC-Record-ID']}: payload {digest}, declared {declared}")
                    rows.append((
                        None if page_id is None else int(page_id), r.headers["WARC-Record-ID"], r.headers["WARC-Type"], r.headers.get("WARC-Refers-To"), length, digest,
                    ))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def archive_pages(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    gzipped: bool = True,
) -> DataFrame:
    """Convert pages, as legacy archives, to WARC files below ``path`` and read those back.

    Returns per page row ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    Of records with equal payloads of ``min_bytes`` or more, that with the smallest
    page id is a response and the others are revisits without payload, whose length and digest are
    those of the response's payload as read; of rows that repeat a page, one is the response.
    A null page id is kept as null and never referred to while its group has
    others; a null html is an empty payload, a null URL ``about:blank``; any URL, ``filedesc:`` too,
    is a page's.  An empty table writes no records and gives an empty result.
    """
    spark = pages.sparkSession
    with small_batches(spark):
        arcs = written(arc_files(pages, id_col, url_col, html_col), "arcs", ARCHIVE_GROUPS)
        records = written(converted(arcs), "records", RECORD_GROUPS)  # read twice, so the same records both times
        discard(spark, arcs)
        first = (
            records.filter(F.col("payload_bytes") >= min_bytes)
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")).alias("first"), F.count("*").alias("n"))
            .filter("n > 1")
            .select("digest", F.col("first.record_id").alias("first_id"))
        )
        again = (F.col("first_id") != F.col("record_id")) & (F.col("payload_bytes") >= min_bytes)
        known = records.join(broadcast_if_small(written(first, "shared_payloads")), "digest", "left")
        write_warcs(known.withColumn("refers_to_id", F.when(again, F.col("first_id"))), path, gzipped)
        discard(spark, records)
        back = checkpointed(read_warcs(spark, path))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = back.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")).select(out)
    targets = back.filter("record_type = 'response'").select(
        F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("read_bytes"), F.col("payload_digest").alias("read_digest")
    )
    referring = back.filter("refers_to_id is not null").join(targets, F.col("refers_to_id") == F.col("target_id"), "left")
    referring = referring.withColumns({"payload_bytes": F.coalesce("read_bytes", "payload_bytes"), "payload_digest": F.coalesce("read_digest", "payload_digest")})
    return plain.unionByName(referring.select(out))


def op3_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through legacy archives to WARC files and back."""
    return archive_pages(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
g AS (SELECT hex, min(page_id) AS first FROM p GROUP BY 1),
bits AS (SELECT hex, string_agg(lpad(bin(CAST('0x' || substr(hex, i, 1) AS INT)), 4, '0'), '' ORDER BY i) AS b
         FROM (SELECT hex, unnest(range(1, 41)) AS i FROM g) GROUP BY 1),
digest AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(b, 5 * j + 1 + k, 1) AS INT) * (16 >> k)))::INT, 1), '' ORDER BY j) AS d
           FROM (SELECT hex, b, unnest(range(0, 32))::INT AS j FROM bits) GROUP BY 1)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN g USING (hex) JOIN digest USING (hex)
"""
