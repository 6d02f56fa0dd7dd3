"""Quality classifier: a byte-level convolutional network, trained and applied with numpy.

Bytes are embedded; filters eight bytes wide and four apart run over the whole text. Their greatest response within each
chunk of 512 bytes (chunks overlap by half) is rectified; the mean over all chunks and the maximum over them go, by one
weighted sum, into a probability. Training (Adam on the log loss) takes a bounded, hashed sample of labelled rows; scoring
covers every byte of every document and sees nothing but its text.

Null text counts as empty, which is scored too. Equal texts have equal scores; repeated rows stay. Labels without a
document, or null, are left out; with labels of a single kind or none the score is their smoothed share. Only ``doc_id``
and ``text`` (of labels ``doc_id`` and ``quality``) are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import crc_remainder, slices, table, text_column

DIM, STEP, FILTERS = 8, 4, 24
STRETCH = 256  #: bytes; a chunk is two of them, and begins at each
GROUPS = STRETCH // STEP
WINDOW, BYTES_AT_ONCE = 1024, 4 << 20
#: Labelled rows that training takes at most.
SAMPLE_ROWS = 3000
#: And their bytes together.
SAMPLE_BYTES = 64 << 20
#: Passes over the sample, more where it is so small that they would have fewer steps.
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 500, 32, 4e-3
HELD_OUT_OF = 5
THRESHOLD = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded with zero bytes to whole stretches (one at least), and where each text's stretches begin."""
    raw = [t.encode("utf-8") for t in texts]
    sizes = [max(1, -(-len(r) // STRETCH)) for r in raw]
    joined = b"".join(r.ljust(n * STRETCH, b"\0") for r, n in zip(raw, sizes, strict=True))
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Network:
    """A filter spans two groups of four bytes; beyond a text's end there are zero bytes."""

    embedding: np.ndarray  # 256 x DIM
    left: np.ndarray  # STEP * DIM x FILTERS
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    offset: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(f32(256, DIM, scale=0.5), f32(STEP * DIM, FILTERS, scale=0.2), f32(STEP * DIM, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.left, self.right, self.bias, self.out, self.offset]

    def responses(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters' responses (groups x FILTERS) and the embedded groups."""
        groups = self.embedding[data].reshape(-1, STEP * DIM)
        beyond = groups @ self.right
        after = np.empty_like(beyond)
        after[:-1] = beyond[1:]
        after[starts[1:] * GROUPS - 1] = np.tile(self.embedding[0], STEP) @ self.right
        after += groups @ self.left
        after += self.bias
        return after, groups

    def pooled(self, stretches: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks' rectified maxima from those of the stretches, where the chunks of each text begin, and each chunk's first stretch."""
        n = np.diff(starts)
        first = np.concatenate([np.arange(a, max(a + 1, b - 1)) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        second = np.minimum(first + 1, np.repeat(starts[1:] - 1, np.maximum(1, n - 1)))
        return np.maximum(np.maximum(stretches[first], stretches[second]), 0), np.concatenate([[0], np.cumsum(np.maximum(1, n - 1))]), first

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1. Texts are taken by about ``BYTES_AT_ONCE``, and a longer one by itself."""
        ends = np.cumsum([len(t) for t in texts]) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)]
        return np.concatenate([self.scores_of(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def scores_of(self, texts: list[str]) -> np.ndarray:
        """The filters run over windows of ``WINDOW`` stretches and the one behind, so that their responses take the same memory for any text."""
        data, starts = laid_out(texts)
        stretches = np.empty((starts[-1], FILTERS), np.float32)
        for lo in range(0, len(stretches), WINDOW):
            hi = min(lo + WINDOW, len(stretches))
            behind = min(hi + 1, len(stretches))
            inner = starts[np.searchsorted(starts, lo, "right") : np.searchsorted(starts, behind, "left")]
            z, _ = self.responses(data[lo * STRETCH : behind * STRETCH], np.array([lo, *inner, behind]) - lo)
            stretches[lo:hi] = z.reshape(-1, GROUPS, FILTERS).max(1)[: hi - lo]
        chunks, begin, _ = self.pooled(stretches, starts)
        mean = np.add.reduceat(chunks.astype(np.float64), begin[:-1]) / np.diff(begin)[:, None]
        top = np.maximum.reduceat(chunks, begin[:-1])
        logit = (np.concatenate([mean, top], 1) * self.out).sum(1) + self.offset[0]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def gradients(self, texts: list[str], labels: np.ndarray) -> list[np.ndarray]:
        data, starts = laid_out(texts)
        z, groups = self.responses(data, starts)
        z = z.reshape(-1, GROUPS, FILTERS)
        where = z.argmax(1)
        stretches = np.take_along_axis(z, where[:, None], 1)[:, 0]
        chunks, begin, first = self.pooled(stretches, starts)
        n = np.diff(begin)
        mean, top = np.add.reduceat(chunks, begin[:-1]) / n[:, None], np.maximum.reduceat(chunks, begin[:-1])
        features = np.concatenate([mean, top], 1)
        error = ((1 / (1 + np.exp(-np.clip(features @ self.out + self.offset, -40, 40))) - labels) / len(labels)).astype(np.float32)
        d_features = error[:, None] * self.out
        own = np.repeat(np.arange(len(n)), n)
        highest = chunks == top[own]
        ties = np.add.reduceat(highest.astype(np.float32), begin[:-1])
        d_chunks = d_features[own, :FILTERS] / n[own, None] + d_features[own, FILTERS:] * highest / ties[own]
        d_chunks *= chunks > 0
        second = np.minimum(first + 1, starts[1:][own] - 1)
        from_first = stretches[first] >= stretches[second]
        d_stretches = np.zeros_like(stretches)
        np.add.at(d_stretches, first, d_chunks * from_first)
        np.add.at(d_stretches, second, d_chunks * ~from_first)
        # each stretch's response came from one group, and that group's follower in the text
        at = (np.arange(len(where))[:, None] * GROUPS + where).ravel()
        d = d_stretches.ravel()
        k = np.tile(np.arange(FILTERS), len(where))
        live = d != 0
        at, d, k = at[live], d[live], k[live]
        ends = np.zeros(len(groups), bool)
        ends[starts[1:] * GROUPS - 1] = True
        after = np.where(ends[at][:, None], np.tile(self.embedding[0], STEP), groups[np.minimum(at + 1, len(groups) - 1)])
        sums = np.zeros((FILTERS, len(at)), np.float32)
        sums[k, np.arange(len(at))] = d
        d_left, d_right = (sums @ groups[at]).T, (sums @ after).T
        d_embedding = np.zeros_like(self.embedding)
        codes = data.reshape(-1, STEP)
        next_codes = np.where(ends[at][:, None], 0, codes[np.minimum(at + 1, len(groups) - 1)])
        np.add.at(d_embedding, codes[at].ravel(), (d[:, None] * self.left.T[k]).reshape(-1, DIM))
        np.add.at(d_embedding, next_codes.ravel(), (d[:, None] * self.right.T[k]).reshape(-1, DIM))
        return [d_embedding, d_left, d_right, np.bincount(k, d, FILTERS).astype(np.float32), error @ features, error.sum(keepdims=True)]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net, labels = Network.fresh(rng), np.asarray(labels, np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.offset[:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(texts) // BATCH)))
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            rate = RATE * min(1, step / 20) * (1 - step / (total + 1))
            for p, g, m, v in zip(net.parameters(), net.gradients([texts[i] for i in own], labels[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on at most ``sample_rows`` labelled texts, those of least hash, that are not held out.

    Of texts in this order those are taken that fit into ``sample_bytes`` together. Rows of one id, text and label count once, so
    what goes to the driver is bounded however often an id recurs.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter("quality is not null").filter(crc_remainder(F.col("doc_id"), HELD_OUT_OF) != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    sized = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "quality", F.octet_length("text").alias("size")).distinct()
    room, wanted = sample_bytes, []
    for r in sized.orderBy(F.xxhash64("doc_id"), "doc_id", "h", "quality").limit(sample_rows).collect():
        if r["size"] <= room:
            room -= r["size"]
            wanted.append((r["doc_id"], r["h"], r["quality"]))
    if not wanted:
        return train([], np.zeros(0, np.float32))
    keys = F.broadcast(docs.sparkSession.createDataFrame(wanted, "doc_id long, h long, quality int"))
    found = texts.join(keys.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).join(keys, ["doc_id", "h"])
    rows = sorted(found.groupBy("doc_id", "h", "quality").agg(F.first("text").alias("text")).collect(), key=lambda r: (r["doc_id"], r["text"], r["quality"]))
    return train([r["text"] for r in rows], np.array([r["quality"] for r in rows], np.float32))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            s = net.scores(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [f.split()[0] for f in SCHEMA.split(", ")])

    held_out = crc_remainder(F.col("doc_id"), HELD_OUT_OF) == 0
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_column().alias("text")).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, trained on them and ``labels``, does not reject."""

    net = fit(docs, labels)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([net.scores(texts[i : i + 128].tolist()) for i in range(0, len(texts), 128)]) if len(texts) else np.zeros(0))

    return docs.filter(probability(text_column()) >= THRESHOLD)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
