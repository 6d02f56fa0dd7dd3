"""Notes: distillation of pending conversations, keyed upserts, and vectors of another model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.chunks import CHUNK_BUDGET, chunks
from sessionlake.functions.text import content_hash, merge_notes, parse_note, render_note, scrub
from sessionlake.functions.vectors import is_valid
from sessionlake.operators.captures import conversation_stats, majority_repo, repo_of_metadata, transcript_text
from sessionlake.operators.decisions import distinct_decisions
from sessionlake.operators.jobs import enqueued
from sessionlake.schemas import TABLES
from sessionlake.sources.store import Conflict, Snapshot, Store


class Embedder(Protocol):
    """``embed(texts, kind)`` gives a row of ``dim`` numbers for each text; kind is ``query`` or ``document``."""

    id: str
    dim: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder for tests: signed sums of the words' hashes, at unit length."""

    def __init__(self, dim: int = 64, name: str = "hashing"):
        self.id, self.dim = name, dim

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split() or [""]:
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
            row[0] += 0 if row.any() else 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def pool(tokens: np.ndarray, mask: np.ndarray, how: str = "mean", normalize: bool = True) -> np.ndarray:
    """Token vectors (texts x tokens x dim) to text vectors: the mean of unmasked ones, or the first.

    Masked tokens do not enter at all, whatever they hold. A mask that is not binary, or empty for a text, is an error.
    """
    if mask.shape != tokens.shape[:2] or not np.isin(mask, (0, 1)).all():
        raise ValueError("the mask must be binary, one for each token")
    if not mask.any(axis=1).all():
        raise ValueError("a text without tokens")
    out = tokens[:, 0] if how == "cls" else np.where(mask[:, :, None] == 1, tokens, 0).sum(1) / mask.sum(1, keepdims=True)
    if normalize:
        norm = np.sqrt((out.astype(float) ** 2).sum(1, keepdims=True))
        if not (norm > 0).all():
            raise ValueError("a vector of norm zero")
        out = out / norm
    if not np.isfinite(out.astype(np.float32)).all():
        raise ValueError("a vector that is not finite")
    return out.astype(np.float32)


def truncated(tokens: DataFrame, most: int) -> DataFrame:
    """``tokens(id, ids, mask, …)`` cut to their first ``most``. A row without tokens, or a mask that is not binary or not aligned, fails the job."""
    aligned = (F.size("ids") > 0) & (F.size("ids") == F.size("mask")) & F.forall("mask", lambda m: m.isin(0, 1))
    bad = F.raise_error(F.concat(F.lit("tokens and mask do not agree: "), F.col("id").cast("string")))
    cut = {c: F.when(F.coalesce(aligned, F.lit(False)), F.slice(c, 1, most)).otherwise(bad.cast(tokens.schema[c].dataType)) for c in ("ids", "mask")}
    return tokens.withColumns(cut)


def pooled(states: DataFrame, how: str = "mean", normalize: bool = True) -> DataFrame:
    """(id, embedding) of ``states(id, states, mask)``, a vector and a bit for each token."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [pool(np.array([*map(np.asarray, s)], np.float32)[None], np.asarray(m)[None], how, normalize)[0] for s, m in zip(frame["states"], frame["mask"], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "embedding": rows})

    return states.select("id", "states", "mask").mapInPandas(apply, f"id {states.schema['id'].dataType.simpleString()}, embedding array<float>")


def shown(decisions: DataFrame, notes: DataFrame, wanted: str) -> DataFrame:
    """(kind, id, row): the decision of that id, else the note, as JSON; no row if there is neither."""
    one = lambda df, kind, rank: df.filter(F.col("id") == wanted).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*df.columns)).alias("row"))
    return one(decisions, "decision", 0).unionByName(one(notes, "note", 1)).orderBy("rank").limit(1).drop("rank")


def embedded(texts: DataFrame, embedder: Embedder, kind: str = "document", batch: int = 64) -> DataFrame:
    """(id, embedding) of ``texts(id, text)``. Vectors of another dimension, or not finite, fail the job."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(np.asarray(embedder.embed(part["text"].tolist(), kind), np.float32))})

    out = texts.select("id", "text").mapInPandas(apply, f"id {texts.schema['id'].dataType.simpleString()}, embedding array<float>")
    bad = F.raise_error(F.lit(f"a vector of {embedder.id} is not of {embedder.dim} finite numbers")).cast("array<float>")
    return out.withColumn("embedding", F.when(is_valid(F.col("embedding"), embedder.dim), F.col("embedding")).otherwise(bad))


def upserted(notes: DataFrame, fresh: DataFrame, key: tuple[str, ...] = ("site", "conversation_id")) -> DataFrame:
    """All notes after an upsert: an existing key keeps its id alone, all else is the new row's, and its project is open again."""
    old = notes.select(*key, F.col("id").alias("_old"))
    new = fresh.join(old, list(key), "left").withColumn("id", F.coalesce("_old", "id"))
    if "project_id" in notes.columns:
        new = new.withColumn("project_id", F.lit(None).cast("string"))
    return notes.join(fresh.select(*key), list(key), "left_anti").unionByName(new.select(notes.columns))


def distilled(captures: DataFrame, chat: Callable[[Column], Column], now: str, model: str, budget: int = CHUNK_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Notes and their decisions of all captures of the conversations, given a chat function (a column of chunks to one of JSON).

    The whole transcript is scrubbed before it is cut. An answer that is no note fails the job.
    """
    c = captures.select(
        F.struct("site", "conversation_id").alias("conversation"), F.struct("captured_at", "created_at", "seq").alias("position"), F.col("captured_at").alias("at"),
        F.col("conversation_title").alias("title"), "prompt", "response", repo_of_metadata(F.col("metadata")).alias("repo"),
    )
    texts = transcript_text(c).select(F.col("conversation").alias("id"), scrub(F.col("transcript")).alias("text"))
    answers = chunks(texts, budget).select("id", "ix", parse_note(chat(F.col("chunk"))).alias("note"))
    answers = answers.withColumn("note", F.coalesce("note", F.raise_error(F.lit("an answer is no JSON object")).cast(answers.schema["note"].dataType)))
    listed = answers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ix", "note")))["note"].alias("l"))
    merged = listed.select(F.col("id").alias("conversation"), F.when(F.size("l") > 1, merge_notes(F.col("l"))).otherwise(F.col("l")[0]).alias("note"))
    full = conversation_stats(c).join(majority_repo(c), "conversation").join(merged, "conversation")
    note_id = F.sha2(F.to_json(F.struct("conversation.site", "conversation.conversation_id")), 256)
    notes = full.select(
        note_id.alias("id"), "conversation.site", "conversation.conversation_id", F.col("title").alias("conversation_title"), F.col("turn_count").cast("int"), F.col("note.topic"), F.col("note.summary"),
        render_note(F.col("note")).alias("compacted_text"), F.col("note.tags").alias("entity_tags"), F.col("repo").alias("repo_name"), F.lit(None).cast("string").alias("project_id"), F.lit(model).alias("model_used"),
        F.col("first_at").alias("first_captured_at"), F.col("last_at").alias("last_captured_at"), F.lit(now).alias("distilled_at"),
    )
    said = full.select(note_id.alias("note_id"), F.posexplode("note.decisions").alias("ix", "text"))
    return notes, distinct_decisions(said).withColumn("content_hash", content_hash(F.col("text")))


def missing_vectors(rows: DataFrame, shadow: DataFrame) -> DataFrame:
    """Rows that the new model has not embedded yet; a re-embedding goes on from here."""
    return rows.join(shadow.select("id"), "id", "left_anti")


def without_orphans(shadow: DataFrame, rows: DataFrame) -> DataFrame:
    return shadow.join(rows.select("id"), "id", "left_semi")


def require_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with their vectors; one without fails the job."""
    joined = rows.join(vectors, "id", "left")
    kind = vectors.schema["embedding"].dataType
    return joined.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string"))).cast(kind)))


def reembedded(rows: DataFrame, shadow: DataFrame, embedder: Embedder) -> DataFrame:
    """The complete vectors of the new model: what the shadow has of existing rows, and the missing ones."""
    return without_orphans(shadow, rows).unionByName(embedded(missing_vectors(rows, shadow), embedder))


#: Into how many steps a re-embedding is parted, by hash of the id. What a step has embedded is kept once it is through.
STEPS = 16


def shadow_of(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """(id, embedding, step) that a re-embedding has written to ``folder``; none if it has not begun."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>, step int"
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def reembed(rows: DataFrame, folder: str, embedder: Embedder, steps: int = STEPS) -> DataFrame:
    """(id, embedding) of exactly ``rows(id, text)`` by the new model, by way of a shadow in ``folder`` that a next run goes on from.

    Each step is a job that reads its own part of the shadow, embeds the rows missing there and appends them as a whole; so a run that
    died loses the step it was in, and no row of a finished step is embedded again. Rows come and gone since are embedded and left out.
    ``folder`` is one model's alone, in a place that all executors reach.
    """
    spark = rows.sparkSession
    parted = rows.withColumn("step", F.pmod(F.xxhash64("id"), F.lit(steps)).cast("int"))
    for step in range(steps):
        todo = missing_vectors(parted.filter(F.col("step") == step), shadow_of(spark, folder, rows).filter(F.col("step") == step))
        embedded(todo, embedder).write.mode("append").parquet(f"{folder}/step={step}")
    return without_orphans(shadow_of(spark, folder, rows).select("id", "embedding"), rows)


#: Which texts a model's vectors are of.
VECTOR_TEXTS = {"note_vec": ("notes", "compacted_text"), "decision_vec": ("decisions", "decision_text")}


def switch_model(store: Store, folder: str, embedder: Embedder, now: str, fence: Callable[[], bool] | None = None, steps: int = STEPS) -> Snapshot:
    """Embed all notes and decisions by another model and publish vectors, its id and dimension, and a job for links, in one commit.

    The commit holds only if the tables are still those that were embedded; else the rows that came since are embedded as well. A lost
    ``fence`` is a ``Conflict``, and the shadow in ``folder`` stays for whoever takes over. Nothing is done if the model is the store's.
    """
    while True:
        at = store.open()
        if at.meta.get("embedder_id") == embedder.id:
            return at
        texts = {vec: store.table(name, at).select("id", F.col(text).alias("text")) for vec, (name, text) in VECTOR_TEXTS.items()}
        vectors = {vec: reembed(rows, f"{folder}/{embedder.id}/{vec}", embedder, steps) for vec, rows in texts.items()}
        jobs = store.table("jobs", at)
        job = {"id": uuid.uuid4().hex, "kind": "link-cluster", "payload": "{}", "status": "queued", "attempts": 0, "epoch": 0, "created_at": now, "updated_at": now, "seq": (jobs.agg(F.max("seq")).first()[0] or 0) + 1}
        wanted = store.spark.createDataFrame([job], TABLES["jobs"])
        try:
            return store.commit(at, {**vectors, "jobs": jobs.unionByName(enqueued(jobs, wanted))}, {"embedder_id": embedder.id, "embedder_dim": str(embedder.dim)}, fence)
        except Conflict:
            if store.open().revision == at.revision or (fence is not None and not fence()):
                raise
