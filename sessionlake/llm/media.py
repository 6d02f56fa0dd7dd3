"""Media columns: ISO media containers written and walked without decoding their payload.

A text's bytes, padded with zero bytes to a positive multiple of 64, become 64-byte samples of an ``mdat`` box; ``moov``
describes them (timescale, sample sizes, chunk offsets, sync samples). Reading walks the nested boxes, decodes the sample
tables and takes the samples by their byte ranges.

Null text counts as empty (one zero sample). Equal texts give equal bytes, as nothing but the payload enters the file.
Repeated rows stay; only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import slices, table, text_column

SAMPLE_BYTES = 64
TIMESCALE = 8000
SAMPLE_TICKS = 64
SAMPLES_PER_CHUNK = 64
SAMPLES_PER_KEYFRAME = 16
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"))
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def table_box(kind: bytes, form: str, rows: list[tuple[int, ...]]) -> bytes:
    return full_box(kind, struct.pack(">I", len(rows)), b"".join(struct.pack(form, *r) for r in rows))


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % SAMPLE_BYTES or (0 if payload else SAMPLE_BYTES))


def write_media(payload: bytes) -> bytes:
    """A file of ``ftyp``, ``mdat`` and ``moov``; the payload is a positive multiple of 64 bytes."""
    n = len(payload) // SAMPLE_BYTES
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    first = len(ftyp) + len(data) - len(payload)
    chunks = [first + i * SAMPLES_PER_CHUNK * SAMPLE_BYTES for i in range(-(-n // SAMPLES_PER_CHUNK))]
    whole, rest = divmod(n, SAMPLES_PER_CHUNK)
    runs = ([(1, SAMPLES_PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    far = chunks[-1] >= 1 << 32
    duration = n * SAMPLE_TICKS
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        table_box(b"stts", ">II", [(n, SAMPLE_TICKS)]),
        table_box(b"stsc", ">III", runs),
        full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
        table_box(b"co64" if far else b"stco", ">Q" if far else ">I", [(c,) for c in chunks]),
        table_box(b"stss", ">I", [(i,) for i in range(1, n + 1, SAMPLES_PER_KEYFRAME)]),
    )
    minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))), stbl)
    mdhd = full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
    hdlr = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0")
    tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), IDENTITY, bytes(8), version=1)
    mvhd = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), IDENTITY, bytes(24), struct.pack(">I", 2), version=1)
    return ftyp + data + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end) of each box, going into the containers; a size that does not fit is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


def rows_of(data: memoryview, at: int, form: str) -> list[tuple[int, ...]]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = struct.calcsize(form)
    return list(struct.iter_unpack(form, data[at + 8 : at + 8 + n * size]))


def read_media(media: bytes) -> dict:
    """Codec, timescale, duration, byte ranges of the samples' chunks and of the keyframes, from the boxes alone."""
    data = memoryview(media)
    found = {path[-1]: start for path, start, _ in walk(data)}
    (codec,) = struct.unpack_from("4s", data, found[b"stsd"] + 12)
    if data[found[b"mdhd"]] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, found[b"mdhd"] + 20)
    else:
        timescale, duration = struct.unpack_from(">II", data, found[b"mdhd"] + 12)
    fixed, n = struct.unpack_from(">II", data, found[b"stsz"] + 4)
    sizes = [fixed] * n if fixed else [s for (s,) in struct.iter_unpack(">I", data[found[b"stsz"] + 12 : found[b"stsz"] + 12 + 4 * n])]
    offsets = [o for (o,) in (rows_of(data, found[b"co64"], ">Q") if b"co64" in found else rows_of(data, found[b"stco"], ">I"))]
    runs = rows_of(data, found[b"stsc"], ">III")
    keys = [k for (k,) in rows_of(data, found[b"stss"], ">I")] if b"stss" in found else range(1, n + 1)
    starts, chunks, sample = [], [], 0
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        for offset in offsets[first - 1 : last]:
            at = offset
            for size in sizes[sample : sample + per]:
                starts.append(at)
                at += size
            sample += per
            chunks.append((offset, at))
    if len(starts) != n or sum(c * d for c, d in rows_of(data, found[b"stts"], ">II")) != duration:
        raise ValueError("sample tables disagree")
    return {"codec": codec.decode("latin-1").strip(), "timescale": timescale, "duration": duration, "samples": n, "chunks": chunks, "keyframes": [(starts[k - 1], starts[k - 1] + sizes[k - 1]) for k in keys]}


def feature_text(info: dict) -> str:
    """The features in one line; the keyframes' ranges as start+length, comma-joined."""
    frames = ",".join(f"{a}+{b - a}" for a, b in info["keyframes"])
    return f"codec={info['codec']};seconds={info['duration'] / info['timescale']:.6f};samples={info['samples']};keyframes={len(info['keyframes'])};ranges={frames}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container as a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode("utf-8") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array([write_media(padded(r)) for r in raw], pa.binary())], ("doc_id", "n_bytes", "media"))

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests, and the features from the container's boxes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for stored in batch["media"].to_pylist():
                info = read_media(stored)
                payload = b"".join(stored[a:b] for a, b in info["chunks"])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_text(info)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

    return media.mapInArrow(decode, SCHEMA)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(store_media(table(spark, sf_dir, "documents")))


QUERIES = {"op10_media_columns": op10_media_columns}
ORACLE_SQL: dict[str, str] = {}
