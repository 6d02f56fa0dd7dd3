"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A string that a text tokenizer must cut into very short tokens is unlikely to be language. Candidates are runs of
key-like characters that mix letters and digits; known digests (hexadecimal runs of a digest's length), UUIDs and plain
identifiers are excluded before the ratio of characters to tokens is taken.

Null text counts as empty and gives no span. Repeated rows are scanned each by itself. Only ``doc_id`` and ``text`` are
read, so further columns of any name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import slices, table, text_column

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: Maximal runs that are long enough; shorter runs would be dropped anyway.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: Words, camel case included, joined by marks, with at most a short number at an end of each: names, slugs, paths, versions.
WORD = r"(\d{0,4}[a-z]*([A-Z]+[a-z]+)*[A-Z]*\d{0,4}|\d+)"
PART = re.compile(WORD)
#: Between two words; candidates are split here and each part tested alone, as one pattern of all could part a run of marks anew.
MARKS = re.compile(r"[/_-]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"


def tiktoken_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or tiktoken_file(), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(candidate: str) -> bool:
    """Digests, UUIDs and identifiers, which are no secrets however few characters their tokens have."""
    if DIGEST.fullmatch(candidate) and len(candidate) in DIGEST_LENGTHS:
        return True
    return bool(UUID.fullmatch(candidate)) or all(map(PART.fullmatch, MARKS.split(candidate.rstrip("="))))


def inefficient(text: str, path: str | None, max_ratio: float) -> list[tuple[int, int]]:
    """Spans whose characters per token are at most ``max_ratio``."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not is_known(run):
            if len(run) <= max_ratio * len(encoding(path).encode_ordinary(run)):
                found.append(m.span())
    return found


def find_spans(text: str, path: str | None = None, max_ratio: float = 2.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then by the order of :data:`KINDS`."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(start, 3, end) for start, end in inefficient(text, path, max_ratio)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(spans)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with each stretch that spans cover, together, replaced by ``mark``."""
    parts, at, covered = [], 0, -1
    for _, start, end in spans:
        if start >= covered:
            parts += [text[at:start], mark]
        covered = at = max(covered, end)
    return "".join(parts) + text[at:]


def scan_secrets(docs: DataFrame, tokenizer: str | None = None, max_ratio: float = 2.0) -> DataFrame:
    """One row per document: counts by kind, all spans, and a digest of the pattern spans alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                spans = find_spans(text, tokenizer, max_ratio)
                base = [s for s in spans if s[0] != "token"]
                kinds = [k for k, _, _ in spans]
                rows.append((doc_id, *map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            names = ("doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans")
            types = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, tokenizer: str | None = None, max_ratio: float = 2.0) -> DataFrame:
    """All documents with their columns; in those that hold secrets, these are replaced and ``n_chars`` is counted anew.

    A document without spans keeps its text and ``n_chars`` as they are, null included.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redacted(t, find_spans(t, tokenizer, max_ratio)))

    cleaned = docs.withColumn("_clean", clean(F.col("text")))
    changed = ~F.col("_clean").eqNullSafe(F.col("text"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.withColumn("text", F.col("_clean")).select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scans": op1_secret_scans}
ORACLE_SQL: dict[str, str] = {}
