"""Best-fit packing of tokenised documents by minimum bin slack.

A document's token ids end with id 0. Documents longer than a sequence are cut into full pieces, the first of which may be
shorter; all pieces are then combined into as few sequences as the heuristic finds. Pieces of one length are
interchangeable, so the plan needs only how many there are of each length: at most 2048 numbers, whatever the corpus. Per
bin, with the longest remaining piece in place, a subset-sum program over bitsets finds the fullest combination of what
is left, which is removed as often as its lengths last. Spark numbers the pieces of each length (by blocks, so that no
length meets in one task) and looks up their places.

Null text counts as empty: one piece that holds only id 0. Repeated rows and ids are packed each by itself. Only
``doc_id`` and ``text`` are read, further columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, slices, table, text_column

CAPACITY = 2048
END = struct.pack("<I", 0)
BLOCK_ROWS = 16_384
#: What the vocabulary's pattern takes for white space. The pattern looks ahead at each blank of a run, one call deeper
#: each, so runs of so many are told before it sees them.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_encoding: list = []


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoding(path: str | None):
    """The file's vocabulary, whose ids are in the order of its merges, for tiktoken: the same ids as by tokenizers, sooner.

    Beside it the added tokens, which are no part of the merges, and a pattern of them. Their strings in a text are these tokens.
    """
    if not _encoding or _encoding[0] != path:
        import public_tokenizers
        import tiktoken

        with open(path or tokenizer_file(), encoding="utf-8") as f:
            found, added = (x := json.load(f))["model"]["vocab"], {t["content"]: t["id"] for t in x["added_tokens"]}
        byte = byte_of()
        ranks = {bytes(byte[c] for c in word): rank for word, rank in found.items() if word not in added}
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        _encoding[:] = path, (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added, pattern)
    return _encoding[1]


def ordinary(vocabulary, text: str) -> list[int]:
    """The ids of a text without added tokens.

    By the pattern, a run of white space is one piece up to its end, or up to its last character if other text follows, to which
    that one may belong. Long runs are cut there and merged as the piece that they are, so the ids stay the same.
    """
    at, out = 0, []
    for run in LONG_BLANKS.finditer(text) if len(text) >= 4096 else ():
        stop = run.end() - (run.end() < len(text))
        out += vocabulary.encode_ordinary(text[at : run.start()]) + vocabulary._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + vocabulary.encode_ordinary(text[at:])


def encode(texts: list[str], path: str | None = None) -> list[bytes]:
    """Each text's ids as little-endian 32-bit numbers, without the end."""
    vocabulary, added, pattern = encoding(path)

    def ids(text: str) -> list[int]:
        if not added or not pattern.search(text):
            return ordinary(vocabulary, text)
        return [i for part in pattern.split(text) for i in ([added[part]] if part in added else ordinary(vocabulary, part))]

    return [np.array(ids(t), "<u4").tobytes() for t in texts]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document. ``nth`` numbers those of one length within a ``block``, a stretch of one task's rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, rows = TaskContext.get().partitionId() << 32, Counter(), 0
        for batch in slices(batches):
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist(), path), strict=True):
                ids += END
                n, start = len(ids) // 4, 0
                stop = (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    length = stop - start
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * stop]), block, seen[length]))
                    seen[length] += 1
                    start, stop = stop, stop + capacity
            rows += len(out)
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])
            if rows >= BLOCK_ROWS:
                block, seen, rows = block + 1, Counter(), 0

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The combination of available lengths with the greatest sum within ``room``, by subset sums in the bits of a number."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        steps.append((length, reach))
        left, some = min(counts[length], room // length), 1
        while left:
            take = min(some, left)
            reach |= reach << take * length & mask
            left, some = left - take, 2 * some
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            chosen[length] += 1
    return chosen


@dataclass
class Plan:
    """Where the pieces of each length go, by stretches of their numbers; sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for n in np.unique(length):
            lo, hi = np.searchsorted(self.length, [n, n + 1])
            own = length == n
            at[own] = lo + np.searchsorted(self.first[lo:hi], number[own], "right") - 1
        q = number - self.first[at]
        return self.sequence[at] + q // self.uses[at], self.offset[at] + q % self.uses[at] * length


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length. The same combination is taken as often as all its lengths last."""
    counts, rows, sequences, used = dict(histogram), [], 0, Counter()
    while longest := max((n for n, c in counts.items() if c), default=0):
        counts[longest] -= 1
        combination = fullest(counts, capacity - longest)
        counts[longest] += 1
        combination[longest] += 1
        times, offset = min(counts[n] // k for n, k in combination.items()), 0
        for n, k in combination.items():
            rows.append((n, used[n], k, sequences, offset))
            used[n] += times * k
            counts[n] -= times * k
            offset += n * k
        sequences += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = materialize(pieces(docs, path, capacity), "pieces")
    by_block = cut.groupBy("length", "block").count()
    plan = minimum_slack({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.places(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [f.split()[0] for f in SCHEMA.split(", ")])

    return numbered.mapInArrow(place, SCHEMA)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
