"""Legacy web archives: ARC files of either version, converted to WARC and read back.

An ARC file starts with a version block, whose second line tells the version and whose third names the fields of each
document's header line: version 1 has ``URL IP-address Archive-date Content-type Archive-length``, version 2 has the result
code, checksum, location, offset and file name as well. The converter follows the declared lengths, and makes WARC records
with identifiers, timestamps, types and digests of their own. Equal payloads are stored once: that of the smallest page id
as a response, the others as revisits of it.

Archives are binary columns (rows of one table in the shared folder), each a stretch of one task's pages, so a page is
never gathered with others of its kind. Null html is an empty payload, a null url an empty one. Rows with equal page ids
and payloads are one response each, as none is smaller. A null page id is never referred to if there is another. Only
``page_id``, ``url`` and ``html`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, slices, table

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
PAGE_FIELD = b"X-Page-Id"
ARCHIVE_BYTES = 4 << 20
LEVEL = 1
#: Repeated payloads whose firsts are broadcast, the most frequent ones: some megabytes.
FEW = 20_000

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC


def arc_url(url: str | None) -> str:
    """A header line's fields are parted by blanks, so those in a URL are escaped; an empty URL is written as ``-``."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url or "") or "-"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    tag = b"" if page_id is None else b"%s: %d\r\n" % (PAGE_FIELD, page_id)
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), tag) + payload


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 -\n{V1_FIELDS if version == 1 else V2_FIELDS}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain ".encode() + (b"" if version == 1 else f"200 - - 0 {name} ".encode()) + b"%d\n" % len(body) + body


def arc_document(version: int, name: str, offset: int, url: str | None, date: str, document: bytes) -> bytes:
    head = f"{arc_url(url)} 0.0.0.0 {date} text/html "
    if version == 2:
        head += f"200 {zlib.crc32(document):08x} - {offset} {name} "
    return b"%s%d\n" % (head.encode(), len(document)) + document + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Each document's header fields by name, ``version``, and its bytes as ``document``; the version block comes first.

    The number of fields of the first line and the second line must tell the same version; a length that goes beyond the
    file is an error.
    """
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        values = data[at:stop].decode("utf-8").split(" ")
        length, start = int(values[-1]), stop + 1
        if start + length > len(data):
            raise ValueError("a document is cut off")
        document = data[start : start + length]
        if not version:
            lines = document.decode("utf-8").split("\n")
            version, names = int(lines[0].split(" ")[0]), lines[1].split(" ")
            if names != {1: V1_FIELDS, 2: V2_FIELDS}.get(version, "").split(" "):
                raise ValueError(f"unknown ARC version: {lines[:2]}")
        if len(values) != len(names):
            raise ValueError(f"{len(values)} header fields, not {len(names)}")
        if "Checksum" in names and (sum_ := values[names.index("Checksum")]) not in ("-", f"{zlib.crc32(document):08x}"):
            raise ValueError(f"checksum {sum_} does not hold")
        yield dict(zip(names, values, strict=True)) | {"version": version, "document": document}
        at = start + length


# --- WARC


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = stop + 4
        end = start + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record's length does not hold")
        yield headers, data[start:end]
        at = end + 4


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What each gzip member holds. Stretches are fed one by one, so that no member has the whole rest of the archive copied."""
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            fed = data[at : at + step]
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        yield b"".join(parts)


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def converted(arc: dict, page_id: int | None, refers_to: int | None, refers_url: str | None) -> bytes:
    """A WARC record of an ARC document: a response with its bytes, or a revisit with its HTTP head alone."""
    head, _, payload = arc["document"].partition(b"\r\n\r\n")
    digest = base32_sha1(payload)
    stamp = datetime.strptime(arc["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = [("WARC-Type", "response" if refers_url is None else "revisit"), ("WARC-Record-ID", record_id(page_id, arc["URL"], digest)), ("WARC-Date", stamp), ("WARC-Target-URI", arc["URL"]), ("WARC-IP-Address", arc["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_url is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_url, digest)), ("WARC-Refers-To-Target-URI", refers_url), ("WARC-Refers-To-Date", stamp), ("X-Refers-To-Page-Id", str(refers_to))]
        return warc_record(headers, head + b"\r\n\r\n")
    return warc_record([*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(arc['document'])}")], arc["document"])


def http_fields(block: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])


# --- Spark


def write_arc(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """(name, version, arc): archives of some megabytes; odd and even ones take turns in the version."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ("name", "version", "arc"))

        count, parts, size, version, name = 0, [], 0, 1, ""
        for batch in slices(batches, 64):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    version, count = 1 + count % 2, count + 1
                    name = f"pages-{count:05d}.arc"
                    parts = [arc_version_block(version, name, date)]
                    size = len(parts[0])
                parts.append(arc_document(version, name, size, url, date, http_response(page_id, (html or "").encode("utf-8"))))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    parts = []
        if parts:
            yield done()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "name string, version int, arc binary")


def arc_documents(archives: DataFrame, documents: bool = True) -> DataFrame:
    """(page_id, url, digest, head, document): each ARC document with its payload's digest.

    Without ``documents`` these are left out, where heads alone are asked for.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for arc in read_arc(batch["arc"][0].as_py()):
                if arc["URL"].startswith("filedesc://"):
                    continue
                page_id = http_fields(arc["document"]).get(PAGE_FIELD)
                fields = [f"{arc[k]}" for k in V1_FIELDS.split(" ")[:4]]
                rows.append((page_id and int(page_id), arc["URL"], base32_sha1(arc["document"].partition(b"\r\n\r\n")[2]), " ".join(fields), arc["document"] if documents else b""))
            if rows:
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ("page_id", "url", "digest", "head", "document"))

    return archives.select("arc").mapInArrow(parse, "page_id long, url string, digest string, head string, document binary")


def convert(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(warc): WARC archives of gzip members, one a record, of ARC archives. Payloads of ``min_bytes`` or more are stored once.

    The archives are read twice: once for their heads, which tell the first of equal payloads, and once for the documents.
    The firsts of the ``FEW`` most frequent payloads are broadcast, so that no payload with many pages is a key of a shuffle; if
    there are more, the documents that these leave open meet the others by a shuffle.
    """
    heads = arc_documents(archives, documents=False).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    firsts = materialize(heads.filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n"), "firsts")
    frequent = firsts.orderBy(F.desc("n"), "digest").limit(FEW).drop("n")
    judged = arc_documents(archives).join(F.broadcast(frequent), "digest", "left")
    if firsts.count() > FEW:
        others = firsts.drop("n").join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
        still_open = judged.filter("first_url IS NULL").drop("first_id", "first_url").join(others, "digest", "left")
        judged = judged.filter("first_url IS NOT NULL").unionByName(still_open)
    judged = judged.select("page_id", "head", "document", "first_id", "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, 64):
            for page_id, head, document, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arc = dict(zip(V1_FIELDS.split(" "), head.split(" "), strict=False)) | {"document": document}
                payload = len(document.partition(b"\r\n\r\n")[2])
                again = payload >= min_bytes and first_url is not None and first_id != page_id
                parts.append(gzip.compress(converted(arc, page_id, first_id, first_url if again else None), LEVEL, mtime=0))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ("warc",))
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ("warc",))

    return judged.mapInArrow(write, "warc binary")


def index_warc(archives: DataFrame) -> DataFrame:
    """What the records of WARC archives say: one row a record, checked against its block where that holds the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for headers, block in (record for member in members(batch["warc"][0].as_py()) for record in read_warc(member)):
                fields, digest = http_fields(block), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and base32_sha1(block.partition(b"\r\n\r\n")[2]) != digest:
                    raise ValueError(f"digest of {headers['WARC-Record-ID']} does not hold")
                page_id, refers_to = fields.get(PAGE_FIELD), headers.get("X-Refers-To-Page-Id")
                rows.append((page_id and int(page_id), int(fields[b"Content-Length"]), digest, headers["WARC-Type"], refers_to and int(refers_to)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return archives.mapInArrow(read, SCHEMA)


def op6_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_warc(materialize(convert(write_arc(table(spark, sf_dir, "pages"))), "warc"))


QUERIES = {"op6_warc_conversion": op6_warc_conversion}
ORACLE_SQL: dict[str, str] = {}
