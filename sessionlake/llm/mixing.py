"""Mixing sources to target weights, by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected in [0, 1]:
the least one (the flattest mixture) whose repetition stays within a limit, or the one that meets a target entropy. The
weights are realised within a budget of tokens: each source is read in whole epochs and one partial one. An epoch is a
permutation of the source's blocks (about the square root of its documents' number, dealt by a hash of seed, epoch and
document) and of the documents in each. The partial epoch takes blocks from the first on, and of the block in which the
budget ends the documents up to a hash; so at most one block of a source is ever put in order. Without a budget, the least
one is taken that reads every document at least once; then the repetition of a source is its weight over its share, against
the least such ratio.

Tokens are words, and one end for each document, so empty and null texts cost one token. A null source counts as the empty
one. Repeated rows (same id and text) are taken or left together in the partial epoch. Further columns stay; ``docs`` that
are empty give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, table, text_column

WORD = r"[^\x20\x09-\x0D]+"
SEED = 42
MAX_REPEATS = 2.0
#: Sources are categories; their statistics are gathered on the driver, so their number is checked.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Mixture:
    exponent: float
    weights: dict[str, float]
    budget: float
    repeats: dict[str, float]


def weights_of(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    top = max(tokens.values())
    raw = {s: (t / top) ** exponent for s, t in tokens.items()}
    total = math.fsum(raw.values())
    return {s: r / total for s, r in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def repeats_of(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> tuple[float, dict[str, float]]:
    """The budget, by default the least that reads every document once, and how often each source is read."""
    budget = max(t / weights[s] for s, t in tokens.items()) if budget is None else budget
    return budget, {s: budget * weights[s] / t for s, t in tokens.items()}


def temperature(tokens: dict[str, int], max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None) -> Mixture:
    """Bisect the exponent. Entropy falls and repetition of small sources falls as it grows; exponent 1 keeps the shares."""

    def enough(exponent: float) -> bool:
        w = weights_of(tokens, exponent)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        return max(repeats_of(tokens, w, budget)[1].values()) <= max_repeats

    low, high = 0.0, 1.0
    if enough(low):
        high = low
    for _ in range(60):
        if low == high:
            break
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    w = weights_of(tokens, high)
    budget, repeats = repeats_of(tokens, w, budget)
    return Mixture(high, w, budget, repeats)


def source_key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def drawn(epoch: Column, what: str) -> Column:
    """A number of 63 bits from seed, epoch and the document's key."""
    return F.xxhash64(F.lit(SEED), F.lit(what), epoch, F.col("__key")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def copies(docs: DataFrame, mixture: Mixture | None = None, **aims) -> DataFrame:
    """``docs`` with ``__tokens``, and a row for each time that a document is read: ``__epoch`` from 1, ``__block`` and ``__order`` in it."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__source", source_key()).withColumn("__tokens", (F.regexp_count(text_column(), F.lit(WORD)) + 1).cast("long")).withColumn("__key", F.xxhash64("doc_id", text_column()))
    slim = materialize(keyed.select("__source", "__tokens", "__key"), "mixture")
    found = slim.groupBy("__source").agg(F.count("*").alias("n"), F.sum("__tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not found:
        return keyed.withColumn("__epoch", F.lit(1)).withColumn("__block", F.lit(0).cast("long")).withColumn("__order", F.lit(0).cast("long"))
    mixture = mixture or temperature({r["__source"]: r["t"] for r in found}, **aims)
    rows = []
    for r in found:
        whole = math.floor(mixture.repeats[r["__source"]] + 1e-9)
        rows.append((r["__source"], math.isqrt(r["n"] - 1) + 1, whole, max(0, math.floor((mixture.repeats[r["__source"]] - whole) * r["t"]))))
    plan = spark.createDataFrame(rows, "__source string, __blocks long, __whole long, __rest long")

    partial = slim.join(F.broadcast(plan), "__source").withColumn("__block", drawn(F.col("__whole") + 1, "block") % F.col("__blocks"))
    sizes = partial.groupBy("__source", "__block").agg(F.sum("__tokens").alias("size"), F.first("__rest").alias("__rest"))
    upto = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sizes.withColumn("end", F.sum("size").over(upto)).filter("end > __rest").groupBy("__source").agg(F.min_by(F.struct("__block", (F.col("__rest") - F.col("end") + F.col("size")).alias("left")), "end").alias("b"))
    edge = {r["__source"]: r["b"] for r in ends.collect()}
    plan = spark.createDataFrame([(*r, edge[r[0]]["__block"] if r[0] in edge else r[1], edge[r[0]]["left"] if r[0] in edge else 0) for r in rows], "__source string, __blocks long, __whole long, __rest long, __edge long, __left long")

    at_edge = slim.join(F.broadcast(plan), "__source").filter(drawn(F.col("__whole") + 1, "block") % F.col("__blocks") == F.col("__edge")).withColumn("__order", drawn(F.col("__whole") + 1, "order"))
    ties = Window.partitionBy("__source").orderBy("__order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = at_edge.withColumn("upto", F.sum("__tokens").over(ties)).filter("upto <= __left").groupBy("__source").agg(F.max("__order").alias("__last"))
    cut = {r["__source"]: r["__last"] for r in last.collect()}
    plan = spark.createDataFrame([(r[0], r[1], r[2], edge[r[0]]["__block"] if r[0] in edge else r[1], cut.get(r[0], -1)) for r in rows], "__source string, __blocks long, __whole long, __edge long, __last long")

    following = F.col("__whole") + 1
    block = drawn(following, "block") % F.col("__blocks")
    more = (block < F.col("__edge")) | ((block == F.col("__edge")) & (drawn(following, "order") <= F.col("__last")))
    times = F.col("__whole") + more.cast("long")
    read = keyed.join(F.broadcast(plan), "__source").filter(times > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return read.withColumn("__block", drawn(F.col("__epoch"), "block") % F.col("__blocks")).withColumn("__order", drawn(F.col("__epoch"), "order"))


def mix(docs: DataFrame, **aims) -> DataFrame:
    """The rows of ``docs``, as often as the mixture reads them."""
    return copies(docs, **aims).select(*docs.columns)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return read.select("doc_id", "source", F.col("__tokens").alias("tokens"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__order").alias("place"))


QUERIES = {"op9_temperature_mixing": op9_temperature_mixing}
ORACLE_SQL: dict[str, str] = {}
