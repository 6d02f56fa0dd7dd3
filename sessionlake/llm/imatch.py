"""Document fingerprints by I-Match, over several randomised lexicon subsets.

Of a document's distinct terms those within a band of inverse document frequency stay. Sorted, those that belong to a subset
of the lexicon are hashed, subset by subset. The subsets are drawn at several rates, so that for texts of any length some of
them hold a term or a few of the text and survive edits elsewhere.

A term of the band occurs in at least one of ``RAREST`` documents. By counting, there are at most ``RAREST`` times the mean
number of distinct terms of a document of these, whatever the corpus: only this lexicon is broadcast. Document frequencies
cover all documents, and combine before their shuffle.

A text with fewer than ``LEAST_TERMS`` terms of the band, as where its words are those of a third of all rows, or of a rare
language, takes all its own terms instead: which subsets a term belongs to follows from its hash alone.

Null text counts as empty. A text without terms has the hash of its bytes in place of its terms'. Repeated rows
count as documents each. Documents of equal ids are ordered by text; a null id comes after all others. Only ``doc_id`` and
``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import slices, table, text_column

#: The band: in at least one of so many documents (and in two), and in at most one of so many.
RAREST, COMMONEST = 2000, 10
#: Subsets of the lexicon: one term in so many, and how many subsets at each rate.
RATES, PER_RATE = (2, 8, 32, 128, 512), 12
SUBSETS = PER_RATE * len(RATES)
EMPTY = "----"
LEAST_TERMS = 8
#: Characters in a bucket at least. It grows, as the number of buckets does, with the square root of the corpus, and a task reads
#: its buckets as a sorted stream, document by document.
BUCKET_CHARS, BUCKET_GROWTH, BUCKETS_PER_TASK = 3_000_000, 130, 4
TERMS_AT_ONCE = 500_000

#: Lower case for A-Z, and blanks for control characters, blanks and marks of ASCII.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def terms_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8").translate(PLAIN).split())


def membership(hashes: np.ndarray) -> np.ndarray:
    """Which subsets the terms of these hashes are in (terms x subsets)."""
    member = np.empty((len(hashes), SUBSETS), bool)
    for s in range(SUBSETS):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (s + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        member[:, s] = (mixed >> np.uint64(40)) % np.uint64(RATES[s // PER_RATE]) == 0
    return member


class Lexicon:
    """The terms of the band in order, and which subsets each is in."""

    _last: tuple[list[bytes], Lexicon] | None = None

    def __init__(self, terms: list[bytes]):
        import xxhash

        self.number = {t: i for i, t in enumerate(terms)}
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))
        self.member = membership(self.hashes)

    @classmethod
    def of(cls, spread) -> Lexicon:
        """The lexicon of a broadcast list of terms; built once in a worker."""
        if cls._last is None or cls._last[0] is not spread.value:
            cls._last = (spread.value, cls(spread.value))
        return cls._last[1]

    def fingerprint(self, text: str) -> str:
        """The hash of all terms of the band, and 16 bits for each subset; for a subset without terms, a mark."""
        import xxhash

        own = terms_of(text)
        at = sorted(self.number[t] for t in own if t in self.number)
        if not own:
            return f"{xxhash.xxh64_intdigest(text.encode('utf-8'), 1):016x}" + EMPTY * SUBSETS
        if len(at) >= LEAST_TERMS:
            hashes, member = self.hashes[at], self.member[at]
        else:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, sorted(own)), np.uint64, len(own))
            member = membership(hashes)
        filled = member.any(0)
        digest = xxhash.xxh64_intdigest
        return f"{digest(hashes):016x}" + "".join(f"{digest(hashes[member[:, s]]) & 0xFFFF:04x}" if filled[s] else EMPTY for s in range(SUBSETS))


def likeness(a: str, b: str) -> float:
    """How many subsets agree, of those filled in either text, at the sparsest rate where half of them are filled."""
    if a == b:
        return 1.0
    x, y = (np.array([f[16 + 4 * s : 20 + 4 * s] for s in range(SUBSETS)]).reshape(-1, PER_RATE) for f in (a, b))
    filled, equal = (x != EMPTY) | (y != EMPTY), x == y
    n = filled.sum(1)
    row = max((i for i in range(len(RATES)) if 2 * n[i] >= PER_RATE), default=0)
    return float((filled & equal)[row].sum() / n[row]) if n[row] else 0.0


def lexicon(docs: DataFrame) -> list[bytes]:
    """Terms within the band, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                seen.update(terms_of(text))
            if len(seen) >= TERMS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ("term", "n"))
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ("term", "n"))

    n = docs.count()
    frequencies = docs.select(text_column().alias("text")).mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    band = frequencies.filter(F.col("df").between(max(2, math.ceil(n / RAREST)), max(2, n // COMMONEST)))
    return sorted(band.select("term").toArrow()["term"].to_pylist())


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text) in buckets of descending ids. Each bucket's guest is the document after its last one.

    Buckets are cut at quantiles of the ids, so that no task needs another one's rows to know each document's follower.
    """
    plain = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // max(BUCKET_CHARS, BUCKET_GROWTH * math.isqrt(chars))))
    cuts = []
    if buckets > 1:
        shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
        cuts = plain.agg(F.percentile_approx("doc_id", shares, F.lit(10 * buckets)).alias("q")).first()["q"] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def later(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64)), dtype="int32")

    placed = plain.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(later(F.coalesce("doc_id", F.lit(0)))) if len(bounds) else F.lit(0))
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()
    hosts = {r["bucket"]: firsts[(i + 1) % len(firsts)] for i, r in enumerate(firsts)}
    guests = [(host, r["bucket"], r["first"]) for host, r in hosts.items()]
    known = docs.sparkSession.createDataFrame(guests, "host int, bucket int, first long")
    visiting = placed.join(F.broadcast(known), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("host").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    both = placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(visiting)
    return both.repartition(max(1, -(-len(firsts) // BUCKETS_PER_TASK)), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of each document: its fingerprint, that of its edited text, and how alike these and the next document's are.

    The edited text has, for the last third of the code points, as many of the beginning of the next document.
    """
    spread = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pending, rows = Lexicon.of(spread), None, []
        types = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
        written = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])
        for batch in slices(batches):
            for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = None
                if pending is not None and pending[0] == bucket:
                    own = known.fingerprint(text)
                    _, before, last, print_ = pending
                    third = len(last) // 3
                    edited = last[: len(last) - third] + text[:third]
                    after = known.fingerprint(edited)
                    rows.append((before, len(last), hashlib.sha256(edited.encode("utf-8")).hexdigest(), print_, after, likeness(print_, after), likeness(print_, own)))
                pending = None if guest else (bucket, doc_id, text, own or known.fingerprint(text))
            if len(rows) >= 256:
                yield written()
                rows = []
        if rows:
            yield written()

    return in_order(docs).mapInArrow(compare, SCHEMA)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op2_imatch_fingerprints": op2_imatch_fingerprints}
ORACLE_SQL: dict[str, str] = {}
