"""Semantic retrieval: anchors above a floor, their neighbours by one link, ranked together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import clamp_limit
from sessionlake.functions.vectors import cosine, is_valid
from sessionlake.operators.graph import best_edges

#: Fixed values.
ANCHOR_FLOOR, NEIGHBOUR_CAP = 0.40, 400


def literal_vector(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scored(vectors: DataFrame, query: list[float], floor: float | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``vectors(id, embedding, …)`` with their similarity to the query; those below ``floor``, or not a number, go.

    With ``rows(id)``, only the vectors of these, and one of them that is not of finite numbers fails the job, as an answer that left
    it out would look complete; a broken vector that belongs to no row is not looked at. One of another dimension always fails.
    """
    similarity = cosine(F.col("embedding"), literal_vector(query))
    if rows is not None:
        # The error depends on both sides of the join, so it cannot be raised before it.
        vectors = vectors.join(rows.select("id", F.lit(True).alias("_known")), "id", "left")
        bad = F.raise_error(F.concat(F.lit("a broken vector: "), F.col("id").cast("string"))).cast("double")
        similarity = F.when(F.col("_known"), F.when(is_valid(F.col("embedding"), len(query)), similarity).otherwise(bad))
    out = vectors.withColumn("similarity", similarity).drop("_known").filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    return out if floor is None else out.filter(F.col("similarity") >= floor)


def search(notes: DataFrame, note_vec: DataFrame, decisions: DataFrame, decision_vec: DataFrame, links: DataFrame, query: list[float], limit: object = None, floor: float = ANCHOR_FLOOR, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """(kind, id, similarity, via), ranked: similarity, anchors before links, id, notes before decisions.

    Notes and decisions of at least ``floor`` are anchors. A note outside them that is linked to one comes with its best
    link's weight, which no floor applies to; at most ``cap`` of these are looked up. Ids alone are ranked; ``hydrated`` adds the
    texts. A link to a note that does not exist fails the job if it is among these, and so does a link from an anchor to another
    note whose similarity is null or not finite.
    """
    note_anchors = scored(note_vec, query, floor, notes).select("id", "similarity")
    decision_anchors = scored(decision_vec, query, floor, decisions).select("id", "similarity")
    near = best_edges(links, note_anchors).orderBy(F.desc("similarity"), "id").limit(cap).join(notes.select("id", F.lit(True).alias("known")), "id", "left")
    missing = F.raise_error(F.concat(F.lit("a missing linked note: "), F.col("id").cast("string"))).cast("double")
    near = near.select("id", F.when(F.col("known"), F.col("similarity")).otherwise(missing).alias("similarity"))
    row = lambda df, kind, via: df.select(F.lit(kind).alias("kind"), "id", "similarity", F.lit(via).alias("via"))
    found = row(note_anchors, "note", "anchor").unionByName(row(near, "note", "link")).unionByName(row(decision_anchors, "decision", "anchor"))
    return found.orderBy(F.desc("similarity"), "via", "id", F.desc("kind")).limit(clamp_limit(limit))


def hydrated(found: DataFrame, notes: DataFrame, decisions: DataFrame) -> DataFrame:
    """What ``search`` found with topic, summary and text, and a decision's date and origin, in the same order.

    ``notes(id, topic, summary, compacted_text)``; ``decisions(id, topic, reason, decision_text, decided_at, provenance)``. The rows
    found are 50 at most, so they are broadcast and each table is passed over once.
    """
    none = F.lit(None).cast("string")
    texts = notes.select(F.lit("note").alias("kind"), "id", "topic", "summary", F.col("compacted_text").alias("text"), none.alias("decided_at"), none.alias("provenance")).unionByName(
        decisions.select(F.lit("decision").alias("kind"), "id", "topic", F.col("reason").alias("summary"), F.col("decision_text").alias("text"), "decided_at", "provenance")
    )
    return texts.join(F.broadcast(found), ["kind", "id"]).select("kind", "id", "topic", "summary", "text", "similarity", "via", "decided_at", "provenance").orderBy(F.desc("similarity"), "via", "id", F.desc("kind"))


@dataclass
class Result:
    """What callers get: rows, or an error and no rows; never a part."""

    rows: list
    error: str | None = None


def fail_closed(make) -> Result:
    """Run ``make()`` to its rows. Any failure gives none of them and the error, as lazy frames may fail late."""
    try:
        return Result(make().collect())
    except Exception as e:  # the contract: an empty answer with an error means "unknown"
        return Result([], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
