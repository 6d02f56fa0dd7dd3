"""Decisions: conflict checks, standing lists, deduplication, ratification and reconciliation with a note's new text."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.checkpoints import checkpointed
from sessionlake.functions.text import clamp_limit, content_hash, js_trim, scrub
from sessionlake.functions.vectors import cosine
from sessionlake.operators.graph import similar
from sessionlake.operators.search import scored

#: Fixed values.
CHECK_CAP, STANDING_TOPIC_CAP = 40, 200


@dataclass(frozen=True)
class Rail:
    """Similarities: at least ``merge`` is the same decision, down to ``judge_low`` a judge decides, below ``floor`` unrelated."""

    link: float
    merge: float
    judge_low: float
    floor: float

    def guarded(self) -> Rail:
        """Similarity alone merges nothing: all from ``judge_low`` on goes to the judge."""
        return Rail(self.link, math.inf, self.judge_low, self.floor)


#: Fixed values, as measured for each embedding space; there is no substitute for a space that was not measured.
RAILS = {
    "hosted": Rail(0.70, 0.70, 0.60, 0.55),
    "local-768": Rail(0.8183, 0.8183, 0.7728, 0.7491),
    "local-384": Rail(0.7176, 0.7176, 0.6127, 0.546),
}
#: Known spaces, and those whose thresholds were measured but which cannot be installed.
DIMENSIONS = {"local-768": 768, "local-384": 384}


class UnknownModel(LookupError):
    pass


class UnmeasuredModel(LookupError):
    pass


def rail_for(model: str) -> Rail:
    if model in RAILS:
        return RAILS[model]
    if model in DIMENSIONS:
        raise UnmeasuredModel(f"thresholds of {model} were never measured")
    raise UnknownModel(model)


def check(decisions: DataFrame, vectors: DataFrame, query: list[float], floor: float, cap: int = CHECK_CAP) -> DataFrame:
    """Decisions of any origin of at least ``floor``, the most similar first, ids settling ties."""
    near = scored(vectors, query, floor).select("id", "similarity")
    return decisions.join(near, "id").orderBy(F.desc("similarity"), "id").limit(cap)


def receipt(found: DataFrame, statement: str, now: str, receipt_id: str) -> DataFrame:
    """(id, statement, surfaced_ids, surfaced_at): the row that each successful check leaves, also one that found nothing.

    ``found`` is the check's result, of ``CHECK_CAP`` rows at most; the ids are in its order.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("away"), "id")))["id"].cast("array<string>")
    return found.agg(listed.alias("surfaced_ids")).select(F.lit(receipt_id).alias("id"), F.lit(statement).alias("statement"), "surfaced_ids", F.lit(now).alias("surfaced_at"))


def standing(decisions: DataFrame, limit: object = None) -> DataFrame:
    """The latest decisions; undated ones last. Vectors are not needed."""
    return decisions.orderBy(F.col("decided_at").desc_nulls_last(), "id").limit(clamp_limit(limit))


def listing(decisions: DataFrame) -> DataFrame:
    """All decisions, the latest first, undated ones last, then by id; without a limit, as a report of all must not be cut."""
    return decisions.orderBy(F.col("decided_at").desc_nulls_last(), "id")


def standing_on_topic(decisions: DataFrame, vectors: DataFrame, query: list[float], floor: float, limit: object = None, cap: int = STANDING_TOPIC_CAP) -> DataFrame:
    """Of the ``cap`` decisions most similar to the topic, the latest; equal dates in the order of similarity, then id."""
    return check(decisions, vectors, query, floor, cap).orderBy(F.col("decided_at").desc_nulls_last(), F.desc("similarity"), "id").limit(clamp_limit(limit))


def band(similarity: Column, exact: Column, rail: Rail) -> Column:
    """What a pair is: ``exact``, ``merge``, ``judge`` or ``none``."""
    merge = F.lit(False) if math.isinf(rail.merge) else similarity >= rail.merge
    return F.when(exact, "exact").when(F.isnan(similarity), "none").when(merge, "merge").when(similarity >= rail.judge_low, "judge").otherwise("none")


def dedup_candidates(incoming: DataFrame, existing: DataFrame, rail: Rail, judge=None) -> DataFrame:
    """(incoming, candidate, similarity, band, also): the decision that each incoming one is the same as, and others that match.

    ``incoming(id, text, embedding)``, ``existing(id, text, created_at, embedding)``. Where texts have equal hashes nothing else is
    looked at. Others are compared with every existing decision that has a vector: all pairs of at least ``judge_low`` are candidates,
    without a limit. ``judge`` is a function of (text column, text column); it gets the pairs of its band alone, which are filtered
    before it is applied. Without a judge, or where it fails to answer, these pairs do not match.
    """
    new = incoming.select(F.col("id").alias("incoming"), F.col("text").alias("new_text"), content_hash(F.col("text")).alias("hash"), F.col("embedding").alias("v"))
    old = existing.select(F.col("id").alias("candidate"), F.col("text").alias("old_text"), content_hash(F.col("text")).alias("hash"), F.col("embedding").alias("w"), "created_at")
    both = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), cosine(F.col("v"), F.col("w"))).otherwise(0.0)
    exact = new.join(old, "hash").select("incoming", "candidate", both.alias("similarity"), F.lit("exact").alias("band"), "created_at")
    alone = new.join(old.select("hash"), "hash", "left_anti").select("incoming", "new_text", "v")
    near = similar(alone.filter("v IS NOT NULL").select(F.col("incoming").alias("id"), "v"), old.filter("w IS NOT NULL").select(F.col("candidate").alias("id"), F.col("w").alias("v")), min(rail.judge_low, rail.merge))
    rest = near.select(F.col("src").alias("incoming"), F.col("dst").alias("candidate"), "similarity").withColumn("band", band(F.col("similarity"), F.lit(False), rail))
    dated = rest.join(old.select("candidate", "old_text", "created_at"), "candidate")
    found = exact.unionByName(dated.filter("band = 'merge'").select(exact.columns))
    if judge is not None:
        asked = dated.filter("band = 'judge'").join(alone.select("incoming", "new_text"), "incoming")
        found = found.unionByName(asked.filter(F.coalesce(judge(F.col("new_text"), F.col("old_text")), F.lit(False))).select(exact.columns))
    listed = found.groupBy("incoming").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("away"), "created_at", "candidate", "band"))).alias("l"))
    best = F.element_at("l", 1)
    return listed.select("incoming", best["candidate"].alias("candidate"), (-best["away"]).alias("similarity"), best["band"].alias("band"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))["candidate"].alias("also"))


def distinct_decisions(listed: DataFrame) -> DataFrame:
    """``listed(note_id, ix, text)`` with one text for each hash of a note: the first."""
    hashed = listed.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.groupBy("note_id", "content_hash").agg(F.min_by("text", "ix").alias("text"), F.min("ix").alias("ix"))


def reconcile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(note_id, content_hash, action): what a note's new decisions mean for its stored ones.

    ``stored(note_id, content_hash, provenance)``, ``fresh(note_id, content_hash)``, each hash once. Ratified rows stay and own
    their hash; distilled rows whose hash is gone are deleted, others kept as they are; new hashes are inserted. Notes that
    ``fresh`` does not name are not touched.
    """
    touched = fresh.select("note_id").distinct()
    old = stored.join(touched, "note_id", "left_semi").select("note_id", "content_hash", "provenance")
    both = old.join(fresh.select("note_id", "content_hash", F.lit(True).alias("fresh")).distinct(), ["note_id", "content_hash"], "full_outer")
    action = F.when(F.col("provenance").isNull(), "insert").when((F.col("provenance") == "ratified") | F.col("fresh").isNotNull(), "keep").otherwise("delete")
    return both.select("note_id", "content_hash", action.alias("action"))


@dataclass(frozen=True)
class Ratified:
    """``decisions`` after all rows, ``outcomes(id, decision_id, action)``, and ``vectors(id, embedding)`` of the rows that are new."""

    decisions: DataFrame
    outcomes: DataFrame
    vectors: DataFrame


def scrubbed(wanted: DataFrame) -> DataFrame:
    """``wanted(text, reason, topic, quote, …)`` without secrets in these four, which goes before hashes and vectors are made of them."""
    return wanted.withColumns({c: scrub(F.col(c)) for c in ("text", "reason", "topic", "quote")})


def ratified(decisions: DataFrame, wanted: DataFrame, now: str, vectors: DataFrame | None = None) -> Ratified:
    """After all of ``wanted(id, text, reason, topic, quote, confirmed, pick)`` are ratified, as in order of id. Secrets go first.

    ``vectors(id, embedding)`` are the decisions', ``wanted.embedding`` that of the scrubbed text; none counts as no similarity.
    The action is ``refuse`` without confirmation or a quote; else the local decision of the same hash (most similar, then
    oldest, then by id) wins over ``pick``, the dedup ladder's choice, and a pick that is gone is none. ``keep`` leaves a decision
    with its first quote, ``upgrade`` ratifies a distilled one, ``requote`` replaces the quote of another text's, ``insert`` adds a row
    and its vector, whose id comes of its hash; of wanted rows of one new hash the first does, others keep it.
    """
    none = F.lit(None).cast("array<double>")
    given = wanted if "embedding" in wanted.columns else wanted.withColumn("embedding", none)
    valid = F.coalesce("confirmed", F.lit(False)) & (js_trim(F.coalesce("quote", F.lit(""))) != "")
    asked = scrubbed(given.withColumn("valid", valid)).withColumn("content_hash", content_hash(F.col("text")))
    local = decisions.filter("origin = 'local'").select("id", "provenance", "content_hash", "created_at")
    stored = local.join(vectors.select("id", F.col("embedding").alias("v")), "id", "left") if vectors is not None else local.withColumn("v", none)
    similarity = F.when(F.col("v").isNotNull() & F.col("embedding").isNotNull(), cosine(F.col("v"), F.col("embedding"))).otherwise(0.0)
    equal = asked.select(F.col("id").alias("asked"), "content_hash", "embedding").join(stored, "content_hash")
    first = equal.groupBy("asked").agg(F.min_by(F.struct("id", "provenance", "content_hash"), F.struct(-similarity, "created_at", "id")).alias("same"))
    picks = local.select(F.col("id").alias("pick"), F.struct("id", "provenance", "content_hash").alias("other"))
    met = asked.join(first.withColumnRenamed("asked", "id"), "id", "left").join(picks, "pick", "left").withColumn("winner", F.coalesce("same", "other"))
    fresh = Window.partitionBy("content_hash", (F.col("valid") & F.col("winner").isNull())).orderBy("id")
    met = met.withColumn("nth", F.row_number().over(fresh))
    action = (
        F.when(~F.col("valid"), "refuse").when(F.col("winner").isNull(), F.when(F.col("nth") == 1, "insert").otherwise("keep")).when(F.col("winner.content_hash") != F.col("content_hash"), "requote")
        .when(F.col("winner.provenance") == "distilled", "upgrade").otherwise("keep")
    )
    made = F.sha2(F.concat_ws("\0", F.lit("ratified"), F.col("content_hash")), 256)
    acted = met.withColumn("action", action).withColumn("decision_id", F.when(F.col("valid"), F.coalesce(F.col("winner.id"), made)))
    # Of an upgraded decision's wanted rows the first gives the quote; one of another text's overwrites it, whichever is the last.
    quotes = acted.filter("action IN ('upgrade', 'requote')").groupBy(F.col("decision_id").alias("id")).agg(
        F.coalesce(F.max_by(F.when(F.col("action") == "requote", F.col("quote")), F.when(F.col("action") == "requote", F.col("id"))), F.min_by("quote", "id")).alias("new_quote")
    )
    updated = decisions.join(quotes, "id", "left").withColumn("provenance", F.when(F.col("new_quote").isNotNull(), "ratified").otherwise(F.col("provenance")))
    updated = updated.withColumn("human_quote", F.coalesce("new_quote", "human_quote")).select(decisions.columns)
    values = {
        "id": F.col("decision_id"), "decision_text": F.col("text"), "reason": F.col("reason"), "topic": F.col("topic"), "content_hash": F.col("content_hash"), "provenance": F.lit("ratified"),
        "human_quote": F.col("quote"), "origin": F.lit("local"), "decided_at": F.lit(now), "created_at": F.lit(now),
    }
    kinds = {f.name: f.dataType for f in decisions.schema.fields}
    inserted = acted.filter("action = 'insert'")
    rows = inserted.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in decisions.columns))
    return Ratified(updated.unionByName(rows), acted.select("id", "decision_id", "action"), inserted.select(F.col("decision_id").alias("id"), "embedding"))


def ratify(decisions: DataFrame, vectors: DataFrame, wanted: DataFrame, rail: Rail, now: str, judge=None) -> Ratified:
    """The same with the ladder's choice as ``pick``: of local decisions with vectors, by the guarded rail, so that a judge decides."""
    clean = checkpointed(scrubbed(wanted.drop("pick")))
    local = decisions.filter("origin = 'local'").join(vectors.select("id", "embedding"), "id").select("id", F.col("decision_text").alias("text"), "created_at", "embedding")
    found = dedup_candidates(clean.select("id", "text", "embedding"), local, rail.guarded(), judge).select(F.col("incoming").alias("id"), F.col("candidate").alias("pick"))
    return ratified(decisions, clean.join(found, "id", "left"), now, vectors)
