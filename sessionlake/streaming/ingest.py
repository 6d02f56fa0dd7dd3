"""Transcripts as a stream: complete records by byte offsets, a session's last user and keys as state, tables of batches as sink."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlake.operators.backfill import captured
from sessionlake.sources.transcripts import LINES, OffsetError, complete_lines, next_offset, records


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def last_record(path: str, block: int = 1 << 16) -> int:
    """The bytes up to a file's last newline, looked for from its end, so that only an open record is read."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - block)
            f.seek(start)
            found = next_offset(f.read(at - start))
            if found:
                return start + found
            at = start
    return 0


class TranscriptReader(DataSourceStreamReader):
    """Offsets are the files' bytes up to their last complete record; a task reads one file's new bytes."""

    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, tuple] = {}

    def _files(self) -> list[str]:
        found = glob.glob(os.path.join(self.root, "*.jsonl")) + glob.glob(os.path.join(self.root, "*", "*.jsonl"))
        return sorted(f for f in found if os.path.isfile(f) and not os.path.islink(f))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Only files that have changed since the last trigger are opened, and of these what follows their last newline is read."""
        known, self.known = self.known, {}
        for path in self._files():
            stat = os.stat(path)
            as_seen = (stat.st_size, stat.st_mtime_ns)
            self.known[path] = known[path] if known.get(path, (None,))[0] == as_seen else (as_seen, last_record(path))
        return {path: end for path, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        shorter = [p for p, stop in end.items() if stop < start.get(p, 0)]
        if shorter:
            raise OffsetError(f"shorter than what was read of them: {shorter}")
        return [Slice(p, start.get(p, 0), stop) for p, stop in end.items() if stop > start.get(p, 0)]

    def read(self, part: Slice) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            data = f.read(part.end - part.start)
        for offset, line in complete_lines(data):
            yield part.path, part.start + offset, line


class TranscriptSource(DataSource):
    """``format("transcripts")`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options["path"])


EVENTS = "kind string, session string, source_key string, prompt string, response string, model string, cwd string, at string, path string, offset long"
STATE = "text string, cwd string, keys array<string>"


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Turns of a session's new records, or a file's bad lines. A session's last user, folder and the keys of its turns are the state.

    A key that the session has had makes no turn again, whichever batch or file it comes in.
    """
    rows = pd.concat(list(frames)).sort_values(["path", "offset"])
    out = []
    if key[0].startswith(BAD):
        out = [("error", None, None, None, None, None, None, None, r.path, r.offset) for r in rows.itertuples()]
    else:
        text, cwd, known = state.get if state.exists else (None, None, [])
        seen = dict.fromkeys(known)
        for r in rows.itertuples():
            if r.role == "user":
                text, cwd = r.text or "", r.cwd
            elif r.text and text is not None and (own := r.uuid or str(r.offset)) not in seen:
                seen[own] = None
                out.append(("turn", key[0], own, text, r.text, r.model, r.cwd or cwd, r.at, r.path, r.offset))
        state.update((text, cwd, [*seen]))
    yield pd.DataFrame(out, columns=[f.split()[0] for f in EVENTS.split(", ")])


#: Before a file's name, the group of its bad lines; sessions' ids do not begin so.
BAD = "\0"


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """A stream of turns, and of bad lines beside them, from the transcripts below ``root``; sessions meet their earlier users through state."""
    spark.dataSource.register(TranscriptSource)
    lines = spark.readStream.format("transcripts").option("path", root).load()
    found = records(lines).withColumn("key", F.when(F.col("bad"), F.concat(F.lit(BAD), "path")).otherwise(F.col("session")))
    plain = found.select("key", "path", "offset", "role", "uuid", "text", "cwd", "model", "at")
    return plain.groupBy("key").applyInPandasWithState(_pair, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Sink:
    """For ``foreachBatch``: the tables that a batch of events adds to, each a folder below ``folder`` with one part a batch.

    ``events`` are written first, once; of them come ``captures``, ``errors(path, errors, last_bad_offset)`` and ``jobs``, a distillation for
    each conversation that has new captures. A batch that is run again writes its own parts anew, so nothing is added twice, and no
    batch reads what others have written. ``run`` names the checkpoint, whose batches are numbered from 0.
    """

    folder: str
    run: str
    site: str = "cli"
    clock: Callable[[], str] = lambda: datetime.now(UTC).isoformat()
    repos: DataFrame | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"batch={self.run}-{number:09d}"
        now = self.clock()
        batch.write.mode("overwrite").parquet(f"{self.folder}/events/{part}")
        events = spark.read.schema(batch.schema).parquet(f"{self.folder}/events/{part}")
        turns = events.filter("kind = 'turn'")
        bad = events.filter("kind = 'error'").groupBy("path").agg(F.count("*").alias("errors"), F.max("offset").alias("last_bad_offset"))
        payload = F.to_json(F.struct(F.lit(self.site).alias("site"), F.col("session").alias("conversation_id")))
        jobs = turns.select("session").distinct().select(
            F.sha2(F.concat_ws("\0", F.lit(part), payload), 256).alias("id"), F.lit("distill").alias("kind"), payload.alias("payload"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("epoch"), F.lit(None).cast("string").alias("last_error"),
            F.lit(None).cast("string").alias("run_after"), F.lit(None).cast("string").alias("lease_until"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(number).cast("long").alias("seq"),
        )
        for name, rows in (("captures", captured(turns, self.site, now, self.repos)), ("errors", bad), ("jobs", jobs)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{part}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def captures(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "captures").drop("batch")

    def jobs(self, spark: SparkSession) -> DataFrame:
        """Jobs to enqueue; of one conversation's, the queue takes one."""
        return self.table(spark, "jobs").drop("batch")

    def errors(self, spark: SparkSession) -> DataFrame:
        """(path, errors, last_bad_offset) of all batches: counts add up, the latest offset is that of the last batch."""
        return self.table(spark, "errors").groupBy("path").agg(F.sum("errors").alias("errors"), F.max_by("last_bad_offset", "batch").alias("last_bad_offset"))


def capture(spark: SparkSession, root: str, checkpoint: str, sink: Sink):
    """Ingest all that is there and stop; offsets and state are kept in ``checkpoint``, written after the sink."""
    return read_events(spark, root).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
