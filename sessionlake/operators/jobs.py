"""The durable queue as transitions of a ``jobs`` frame; a single writer commits their results.

Times are comparable values of one type (ISO strings or numbers); ``seq`` is the order of insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KINDS = ("distill", "link-cluster", "reembed", "backfill", "backfill-page")
STATUSES = ("queued", "running", "done", "failed")
LEASE_SECONDS, MAX_ATTEMPTS, BACKOFF_SECONDS, MAX_BACKOFF_SECONDS = 300, 5, 30, 1800


def path(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def backoff_seconds(attempts: Column) -> Column:
    """Doubling from half a minute to half an hour."""
    return F.least(F.lit(MAX_BACKOFF_SECONDS), BACKOFF_SECONDS * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def counts(jobs: DataFrame) -> DataFrame:
    """(status, n) of all statuses, zero where there is no job."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    found = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return known.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def claimable(jobs: DataFrame, now: object) -> DataFrame:
    """Jobs that may be claimed now.

    Queued ones and running ones whose lease is over (strictly), due by now. A re-embedding, even a later one, holds back all
    others, and itself waits for live leases; of a conversation's distillations one runs at a time.
    """
    moment = F.lit(now)
    live = (F.col("status") == "running") & (F.col("lease_until") >= moment)
    due = F.col("run_after").isNull() | (F.col("run_after") <= moment)
    open_ = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < moment))
    flags = jobs.agg(F.coalesce(F.bool_or((F.col("kind") == "reembed") & F.col("status").isin("queued", "running")), F.lit(False)).alias("barrier"), F.coalesce(F.bool_or(live), F.lit(False)).alias("busy"))
    candidates = jobs.filter(open_ & due).join(F.broadcast(flags)).filter(F.when(F.col("kind") == "reembed", ~F.col("busy")).otherwise(~F.col("barrier"))).drop("barrier", "busy")
    running = jobs.filter(live & (F.col("kind") == "distill")).select(path("site").alias("r_site"), path("conversation_id").alias("r_conversation"), F.col("id").alias("r_id"))
    blocked = (F.col("kind") == "distill") & (path("site") == F.col("r_site")) & (path("conversation_id") == F.col("r_conversation")) & (F.col("id") != F.col("r_id"))
    return candidates.join(running, blocked, "left_anti")


def next_claim(jobs: DataFrame, now: object) -> DataFrame:
    """The first of the claimable jobs, in order of creation."""
    return claimable(jobs, now).orderBy("created_at", "seq").limit(1)


def claimed(jobs: DataFrame, now: object, lease_until: object) -> DataFrame:
    """The frame after the next claim."""
    chosen = next_claim(jobs, now).select(F.col("id").alias("chosen"))
    mine = jobs.join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left")
    is_it = F.col("chosen").isNotNull()
    return mine.select(*(_changed(c, is_it, {"status": F.lit("running"), "lease_until": F.lit(lease_until), "attempts": F.col("attempts") + 1, "updated_at": F.lit(now)}) for c in jobs.columns))


def _changed(column: str, when: Column, values: dict[str, Column]) -> Column:
    return F.when(when, values[column]).otherwise(F.col(column)).alias(column) if column in values else F.col(column)


def _fenced(claim: dict) -> Column:
    """Whether a row is still the claim's: its epoch and attempt, and running."""
    return (F.col("id") == claim["id"]) & (F.col("attempts") == claim["attempts"]) & (F.col("epoch") == claim["epoch"]) & (F.col("status") == "running")


def _update(jobs: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    return jobs.select(*(_changed(c, when, values) for c in jobs.columns))


def renewed(jobs: DataFrame, claim: dict, lease_until: object, now: object) -> DataFrame:
    return _update(jobs, _fenced(claim), {"lease_until": F.lit(lease_until), "updated_at": F.lit(now)})


def completed(jobs: DataFrame, claim: dict, now: object) -> DataFrame:
    return _update(jobs, _fenced(claim), {"status": F.lit("done"), "lease_until": F.lit(None), "updated_at": F.lit(now)})


def holds(jobs: DataFrame, claim: dict) -> bool:
    """Whether the claim's fence holds; a commit asks before it publishes."""
    return bool(jobs.filter(_fenced(claim)).head(1))


def failed(jobs: DataFrame, claim: dict, error: str, now: object, retry_at: object, fatal: bool = False) -> DataFrame:
    """A failure: the last attempt, or a fatal one, is put aside; others wait until ``retry_at``."""
    dead = F.lit(fatal) | (F.col("attempts") >= MAX_ATTEMPTS)
    return _update(
        jobs, _fenced(claim), {"status": F.when(dead, "failed").otherwise("queued"), "last_error": F.lit(error), "run_after": F.when(~dead, F.lit(retry_at)), "lease_until": F.lit(None), "updated_at": F.lit(now)}
    )


def rescheduled(jobs: DataFrame, claim: dict, run_after: object, now: object) -> DataFrame:
    """Waiting is no failure: attempts begin anew, in a new epoch."""
    return _update(jobs, _fenced(claim), {"status": F.lit("queued"), "attempts": F.lit(0), "epoch": F.col("epoch") + 1, "run_after": F.lit(run_after), "lease_until": F.lit(None), "updated_at": F.lit(now)})


def retried(jobs: DataFrame, now: object) -> DataFrame:
    """All that failed are queued again."""
    return _update(jobs, F.col("status") == "failed", {"status": F.lit("queued"), "attempts": F.lit(0), "epoch": F.col("epoch") + 1, "run_after": F.lit(None), "last_error": F.lit(None), "updated_at": F.lit(now)})


def given_back(jobs: DataFrame, claim: dict, now: object, run_after: object = None) -> DataFrame:
    """A claim that was never executed does not count as an attempt."""
    return _update(jobs, _fenced(claim), {"status": F.lit("queued"), "attempts": F.col("attempts") - 1, "epoch": F.col("epoch") + 1, "run_after": F.lit(run_after), "lease_until": F.lit(None), "updated_at": F.lit(now)})


def enqueued(jobs: DataFrame, wanted: DataFrame, by_conversation: bool = False) -> DataFrame:
    """Rows of ``wanted`` to insert: of equal payloads one, and none where such a job is queued already.

    With ``by_conversation``, payloads are equal if site and conversation are.
    """
    bad = wanted.filter(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).head(1)
    if bad:
        raise ValueError(f"unknown kind: {bad[0]['kind']}")
    key = [path("site").alias("k1"), path("conversation_id").alias("k2")] if by_conversation else [F.col("payload").alias("k1"), F.lit("").alias("k2")]
    new = wanted.select("*", *key)
    first = new.groupBy("kind", "k1", "k2").agg(F.min("seq").alias("seq"))
    once = new.join(first, ["kind", "k1", "k2", "seq"], "left_semi")
    queued = jobs.filter("status = 'queued'").select("kind", *key)
    return once.join(queued, ["kind", "k1", "k2"], "left_anti").select(wanted.columns)


def pages_of_run(jobs: DataFrame, run: str, start: int) -> DataFrame:
    """A run's page jobs of the slice that begins at ``start``, in order of insertion."""
    mine = (F.col("kind") == "backfill-page") & (path("runJobId") == run) & (path("sliceStart").cast("long") == start)
    return jobs.filter(mine).select("id", "kind", "payload", "status", "last_error", "seq").orderBy("seq").drop("seq")


def live_leases(jobs: DataFrame, now: object) -> DataFrame:
    """(live): running jobs whose lease is not over."""
    return jobs.filter((F.col("status") == "running") & (F.col("lease_until") >= F.lit(now))).agg(F.count("*").alias("live"))


def next_wake(jobs: DataFrame) -> DataFrame:
    """(wake): the least time at which a waiting job is due or a lease ends."""
    return jobs.agg(F.min(F.when(F.col("status") == "queued", F.col("run_after")).when(F.col("status") == "running", F.col("lease_until"))).alias("wake"))
