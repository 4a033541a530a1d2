"""Legacy archive converter: ARC archives in, WARC records out and back.

An ARC archive opens with a version block whose first line names the format
version and whose second line names the header fields; every record after it
is one header line, then as many bytes as that line declares.  The converter
reads those lines by the fields of their version and makes the equivalent WARC
identifier, timestamp, type and digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

# Header fields of the two ARC versions, as their format defines.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ],
}
CRAWL_DATE = "20240101000000"
CRLF = "\r\n"
VERSION_LINE = "WARC/1.1"
#: Records in one archive file, which also ends with its task's share of the rows; a file is read back by one task.
RECORDS_PER_FILE = 2000
#: Pages and bytes at which an ARC archive made from a page table is closed.
PAGES_PER_ARC, ARC_BYTES = 500, 8_000_000
#: Compressed bytes taken in at once when an archive is read.
READ_BYTES = 1 << 18
#: Payloads below this many bytes are never stored as revisits.
REVISIT_BYTES = 1000

PARSED_SCHEMA = (
    "page_id long, record_id string, uri string, warc_date string, ip string, http_head string, "
    "payload string, payload_bytes long, payload_digest string"
)
READ_SCHEMA = (
    "record_id string, record_type string, page_id long, refers_to_id string, payload_bytes long, payload_digest string"
)


def arc_archive(version: int, records: list[tuple[str, bytes]], name: str) -> bytes:
    """An ARC archive of (url, content block) records in the given version."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 latticework\n{' '.join(fields)}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {CRAWL_DATE} text/plain"
    parts = [f"{head} {'' if version == 1 else '200 - - 0 ' + name + ' '}{len(body)}\n".encode(), body]
    offset = sum(map(len, parts))
    for url, block in records:
        values = {
            "URL": quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") or "-", "IP-address": "0.0.0.0",
            "Archive-date": CRAWL_DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": "-",
            "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block)),
        }
        line = (" ".join(values[f] for f in fields) + "\n").encode()
        parts += [line, block, b"\n"]
        offset += len(line) + len(block) + 1
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content block) of each record after the version block."""

    def line_at(at: int) -> tuple[list[str], int]:
        end = data.index(b"\n", at)
        return data[at:end].decode().split(" "), end + 1

    if not data:
        return
    first, at = line_at(0)
    body_end = at + int(first[-1])
    version = int(line_at(at)[0][0])
    fields = ARC_FIELDS[version]
    at = body_end
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        values, at = line_at(at)
        if len(values) != len(fields):
            raise ValueError(f"ARC version {version} header with {len(values)} fields")
        header = dict(zip(fields, values, strict=True))
        end = at + int(header["Archive-length"])
        yield header, data[at:end]
        at = end


def synthesise(header: dict[str, str], block: bytes, place: str) -> tuple:
    """The WARC fields of one ARC record whose block is an HTTP message.

    ``place`` (archive and number in it) tells records apart that are equal in all else.
    """
    head, _, payload = block.partition(b"\r\n\r\n")
    http = head.decode()
    named = dict(x.split(": ", 1) for x in http.split(CRLF)[1:])
    page = named.get("X-Page-Id", "")
    d = header["Archive-date"]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    uri = header["URL"]
    sha = hashlib.sha1(payload).hexdigest()
    record = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {date} {uri} {sha} {place}')}"
    return (
        int(page) if page else None, record, uri, date, header["IP-address"], http, payload.decode(),
        len(payload), sha,
    )


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Pages -> ARC archives (name, content); versions 1 and 2 take turns."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, turn, held = TaskContext.get().partitionId(), 0, 0
        records: list[tuple[str, bytes]] = []

        def close() -> pd.DataFrame:
            name = f"part-{part:05d}-{turn:05d}.arc"
            return pd.DataFrame({"name": [name], "content": [arc_archive(1 + turn % 2, records, name)]})

        for batch in batches:
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                page = "" if page is None else page
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\n\r\n"
                records.append((url or "", (http + (html or "")).encode()))
                held += len(records[-1][1])
                if held >= ARC_BYTES or len(records) >= PAGES_PER_ARC:
                    yield close()
                    records, held, turn = [], 0, turn + 1
        if records:
            yield close()

    # The identifier travels as text: a null would turn a pandas column to floats.
    src = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return src.mapInPandas(pack, "name string, content binary")


def convert_arc(archives: DataFrame) -> DataFrame:
    """ARC archives (name, content) -> one parsed row per record, WARC fields included."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARSED_SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch["name"], batch["content"], strict=True):
                rows = [synthesise(h, b, f"{name} {k}") for k, (h, b) in enumerate(parse_arc(bytes(data)))]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64"})

    return archives.select("name", "content").mapInPandas(convert, PARSED_SCHEMA)


def assign_types(parsed: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``refers_to_id``: the response record that a revisit repeats, else null.

    Of equal payloads of at least ``revisit_bytes``, the largest page id is the
    response.  The choice is a combinable aggregate on the digest; only groups
    of two or more come back to the rows.
    """
    best = (
        parsed.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id")).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", "best")
    )
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    return (
        parsed.join(best, ["payload_digest", "payload_bytes"], "left")
        .withColumn("refers_to_id", F.when(revisit, F.col("best.record_id")))
        .drop("best")
    )


def _record_text():
    """The full WARC record, but for the two line ends that close it."""
    head, revisit = F.col("http_head"), F.col("refers_to_id").isNotNull()
    block = F.concat(head, F.lit(CRLF * 2), F.when(revisit, "").otherwise(F.col("payload")))
    lines = [
        F.lit(VERSION_LINE),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-IP-Address: "), F.col("ip")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                F.lit("WARC-Refers-To: <"), F.col("refers_to_id"), F.lit(">"),
            ),
        ),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(typed: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as gzipped WARC archives by Spark's text sink."""
    (
        typed.select(_record_text().alias("value"))
        .write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def unzipped(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, member after member, in pieces."""
    unzip = zlib.decompressobj(31)
    for at in range(0, len(data), READ_BYTES):
        rest = data[at : at + READ_BYTES]
        while rest:
            yield unzip.decompress(rest)
            rest = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, found by declared lengths; about a record is held at a time."""
    source = iter(pieces)
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                raise ValueError("a WARC header has no end")
            end = held.find(b"\r\n\r\n")
        lines = held[:end].decode().split(CRLF)
        if lines[0] != VERSION_LINE:
            raise ValueError(f"no WARC record at {lines[0]!r}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        end = start + int(header["Content-Length"])
        if not fill(end):
            raise ValueError(f"{header['WARC-Record-ID']} is cut off")
        yield header, bytes(held[start:end])
        fill(end + 4)
        del held[: end + 4]


def read_warc(archives: DataFrame) -> DataFrame:
    """Archives (content) -> one row per record; digests are made anew from payloads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for header, block in parse_warc(unzipped(bytes(data))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page = dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:]).get("X-Page-Id", "")
                    kind, declared = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(header["X-Payload-Length"])
                    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, declared):
                        raise ValueError(f"payload of {header['WARC-Record-ID']} differs from its digest")
                    refers = header.get("WARC-Refers-To")
                    rows.append(
                        (header["WARC-Record-ID"][1:-1], kind, int(page) if page else None,
                         refers and refers[1:-1], size, declared)
                    )
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return archives.select("content").mapInPandas(read, READ_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    A null html is an empty payload; a null url an empty target; a null page_id
    stays null and loses to any other; rows that repeat the largest page_id of
    their payload are all responses.  Other columns are ignored.  An empty
    table gives no archives and no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(assign_types(convert_arc(pages_to_arc(pages))), path)
    archives = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    records = read_warc(archives)
    target = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.max("page_id").alias("refers_to"))
    )
    return records.join(target, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def decoded_target(uri: str) -> str:
    """The address behind a percent-encoded WARC target."""
    return unquote(uri)
