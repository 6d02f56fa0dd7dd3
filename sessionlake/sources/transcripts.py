"""Transcripts: files of newline-terminated JSON records, read by byte offsets."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.checkpoints import checkpointed

LINES = "path string, offset long, line string"


class OffsetError(ValueError):
    pass


def check_offset(data: bytes, offset: object) -> int:
    """An offset is a whole number within the file that stands at its start or just after a newline."""
    if isinstance(offset, bool) or not isinstance(offset, int) or not 0 <= offset <= len(data) or (offset and data[offset - 1] != 10):
        raise OffsetError(f"not the start of a record: {offset!r}")
    return offset


def complete_lines(data: bytes) -> Iterator[tuple[int, str]]:
    """(offset, line) of each terminated record; bytes that are no UTF-8 are replaced. An open last record is left for later."""
    at = 0
    while (stop := data.find(b"\n", at)) >= 0:
        yield at, data[at:stop].decode("utf-8", errors="replace")
        at = stop + 1


def next_offset(data: bytes) -> int:
    return data.rfind(b"\n") + 1


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length) of ``*.jsonl`` in the root and one level below, the latest first, then by path; none if there is no root."""
    empty = "path string, modified timestamp, length long"
    found = spark.createDataFrame([], empty)
    for pattern in (f"{root}/*.jsonl", f"{root}/*/*.jsonl"):
        try:
            listed = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), "length")
        except Exception as e:  # a pattern that matches nothing
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = found.unionByName(listed)
    return found.orderBy(F.desc("modified"), "path")


def _raw(spark: SparkSession, paths: Sequence[str], tolerant: bool) -> DataFrame:
    skipping = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"} if tolerant else {}
    text = spark.read.format("text").option("lineSep", "\n").options(**skipping).load(list(paths))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def _range_bytes(raw: DataFrame) -> DataFrame:
    return raw.groupBy("path", "block").agg(F.sum(F.octet_length("line") + 1).alias("n"))


def broken_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, error) of the files of which fewer bytes can be read than they have, paths as in ``read_lines``.

    A tolerant read leaves the rest of such a file out without a word, so its records must not be used.
    """
    sizes = spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    got = _range_bytes(_raw(spark, paths, True)).groupBy("path").agg(F.sum("n").alias("n"))
    short = sizes.join(got, "path", "left").filter(F.coalesce("n", F.lit(0)) < F.col("size"))
    return short.select("path", F.concat_ws(" ", F.lit("could be read up to byte"), F.coalesce("n", F.lit(0)), F.lit("of"), "size").alias("error"))


def existing(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """Each path with the one that ``read_lines`` gives for it, or none where there is no such file; an empty file, of which Spark has no row, gives ''. Asks once a path; for a page."""
    found: dict[str, str | None] = {}
    for path in paths:
        try:
            row = spark.read.format("binaryFile").load(path).select("_metadata.file_path").first()
            found[path] = row[0] if row else ""
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found[path] = None
    return found


def read_lines(spark: SparkSession, *paths: str, starts: DataFrame | None = None, tolerant: bool = False) -> DataFrame:
    """(path, offset, line, next) of the complete records of files and the offset after each; a file is read by as many
    tasks as it has splits, wherever Spark can read.

    A task gets the lines that begin in its byte range and knows their places within it; where the range's first line begins
    follows from the bytes of the lines of the ranges before, which a first pass adds up (a number a range). A record that no
    newline ends is left for later. Bytes that are no UTF-8 are replaced. With ``starts(path, offset)``, a file's records from its
    offset on, which must be where a record begins or will begin; all others from their start. If ``tolerant``, a file that cannot be
    read does not fail the others: ``broken_files`` tells which these are.
    """
    raw = _raw(spark, paths, tolerant)
    sums = _range_bytes(raw)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(sums.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"), "n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            key = list(zip(batch["path"].to_pylist(), batch["block"].to_pylist(), strict=True))
            step = pc.binary_length(batch["line"]).to_numpy() + 1
            offset, first = np.zeros(len(key), np.int64), 0
            while first < len(key):
                stop = next((i for i in range(first, len(key)) if key[i] != key[first]), len(key))
                at = at if key[first] == current else 0
                ends = at + np.cumsum(step[first:stop], dtype=np.int64)
                offset[first:stop], at, current, first = ends - step[first:stop], ends[-1], key[first], stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset)], ["path", "block", "size", "line", "at"])

    placed = raw.mapInArrow(place, "path string, block long, size long, line binary, at long")
    lines = placed.join(bases.drop("n"), ["path", "block"]).withColumn("offset", F.col("base") + F.col("at"))
    lines = lines.filter(F.col("offset") + F.octet_length("line") + 1 <= F.col("size"))
    if starts is not None:
        lines = _from(lines, starts)
    return lines.select("path", "offset", F.make_valid_utf8(F.col("line").cast("string")).alias("line"), (F.col("offset") + F.octet_length("line") + 1).alias("next"))


def _from(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines from the start of their file on; a start within a record or beyond the last one fails the job."""
    wanted = starts.select("path", F.col("offset").cast("long").alias("start"))
    ends = lines.join(wanted, "path").groupBy("path", "start").agg(
        F.max((F.col("offset") == F.col("start")) | (F.col("offset") + F.octet_length("line") + 1 == F.col("start"))).alias("begins")
    )
    sure = ends.select("path", F.when(F.col("begins") | (F.col("start") == 0), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("not the start of a record: "), F.col("path"), F.lit(" "), F.col("start").cast("string"))).cast("long")).alias("start"))
    # A file without a complete record has no row here; its start can only be 0.
    return lines.join(sure, "path", "left").filter(F.col("offset") >= F.coalesce("start", F.lit(0)))


def checkpoints(lines: DataFrame) -> DataFrame:
    """(path, offset): where each file is to be read on from, the end of its last complete record."""
    return lines.groupBy("path").agg(F.max("next").alias("offset"))


def _string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def content_text(content: Column) -> Column:
    """A string as it is; of a list, the texts of its text blocks, one after the other; otherwise nothing."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(blocks, lambda b: F.when(_string(F.try_variant_get(b, "$.type", "variant")) == "text", _string(F.try_variant_get(b, "$.text", "variant"))))
    return F.coalesce(_string(content), F.array_join(F.filter(texts, lambda t: t.isNotNull()), ""), F.lit(""))


def records(lines: DataFrame) -> DataFrame:
    """(path, offset, bad, role, session, uuid, at, cwd, model, text) of users' and assistants' records, and of bad lines.

    A line that is no JSON is bad, and a user's or assistant's record without session or message, an assistant's without time.
    Other JSON is left out without being an error.
    """
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    get = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "variant")
    role = _string(get("type"))
    out = parsed.select(
        "path", "offset", F.col("v").isNull().alias("broken"), role.alias("role"), _string(get("sessionId")).alias("session"), _string(get("uuid")).alias("uuid"), _string(get("timestamp")).alias("at"),
        _string(get("cwd")).alias("cwd"), _string(get("message.model")).alias("model"), F.coalesce(F.schema_of_variant(get("message")).startswith("OBJECT"), F.lit(False)).alias("has_message"), content_text(get("message.content")).alias("text"),
    ).filter(F.col("broken") | F.col("role").isin("user", "assistant"))
    shape = F.col("session").isNull() | ~F.col("has_message") | ((F.col("role") == "assistant") & F.col("at").isNull())
    return out.withColumn("bad", F.col("broken") | F.coalesce(shape, F.lit(False))).drop("broken", "has_message")


def parse_errors(found: DataFrame, start: int = 0) -> DataFrame:
    """(path, errors, last_bad_offset) of the records that begin at ``start`` or after; earlier ones were counted when they came."""
    return found.filter(F.col("bad") & (F.col("offset") >= start)).groupBy("path").agg(F.count("*").alias("errors"), F.max("offset").alias("last_bad_offset"))


def merged_errors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up; the latest bad offset is the new one where there is one."""
    n = new.select("path", F.col("errors").alias("e"), F.col("last_bad_offset").alias("l"))
    return old.join(n, "path", "full_outer").select("path", (F.coalesce("errors", F.lit(0)) + F.coalesce("e", F.lit(0))).alias("errors"), F.coalesce("l", "last_bad_offset").alias("last_bad_offset"))


def read_checkpoint(text: str | None, size: int) -> int:
    """The offset that a sidecar holds; none means the start. A malformed one or one beyond the file is an error."""
    if text is None:
        return 0
    offset = json.loads(text)["offset"]
    if isinstance(offset, bool) or not isinstance(offset, int) or not 0 <= offset <= size:
        raise OffsetError(f"checkpoint {offset!r}")
    return offset
