"""Captures: pairing of records to turns, keyed inserts, and what conversations add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import repo_leaf


def pair_turns(records: DataFrame, *within: str) -> DataFrame:
    """Turns of ``records(session, position, role, text, cwd, …)``: each assistant with the latest user before it.

    Positions are those in a session, or in its part ``within`` further columns.

    A user is not used up: several assistants may answer. A user's text may be empty, as that of a tool's result is. Assistants
    without text, or before any user, make no turn. The working folder is the assistant's own, else the user's.
    """
    before = Window.partitionBy("session", *within).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "user", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("cwd").alias("cwd")))
    asked = records.filter(F.col("role").isin("user", "assistant")).withColumn("asked", F.last(said, ignorenulls=True).over(before))
    turns = asked.filter((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != "") & F.col("asked").isNotNull())
    return turns.withColumn("prompt", F.col("asked.text")).withColumn("cwd", F.coalesce("cwd", F.col("asked.cwd"))).withColumnRenamed("text", "response").drop("asked", "role")


def turns_of(found: DataFrame, start: int = 0) -> DataFrame:
    """(session, source_key, prompt, response, model, cwd, at, path, offset) of transcript records that begin at ``start`` or after.

    Earlier records are there as context. A session that is in several files is paired in each by itself. A turn's key is the assistant's id, else its byte offset.
    """
    good = found.filter("NOT bad").withColumn("position", F.col("offset"))
    turns = pair_turns(good, "path").filter(F.col("offset") >= start)
    return turns.select("session", F.coalesce("uuid", F.col("offset").cast("string")).alias("source_key"), "prompt", "response", "model", "cwd", "at", "path", "offset")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to insert: the first of each key, none of which exists."""
    first = Window.partitionBy(*key).orderBy(*order)
    once = incoming.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    return once.join(existing.select(*key), key, "left_anti")


def transcript_text(captures: DataFrame) -> DataFrame:
    """(conversation, transcript): prompts and responses in order, parted by blank lines."""
    exchange = F.concat(F.lit("User:\n"), F.col("prompt"), F.lit("\n\nAssistant:\n"), F.col("response"))
    listed = captures.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("position", exchange.alias("x")))).alias("l"))
    return listed.select("conversation", F.array_join("l.x", "\n\n").alias("transcript"))


def conversation_stats(captures: DataFrame) -> DataFrame:
    """(conversation, turn_count, first_at, last_at, title) of ``captures(conversation, position, at, title)``; the latest title there is."""
    return captures.groupBy("conversation").agg(
        F.count("*").alias("turn_count"), F.min_by("at", "position").alias("first_at"), F.max_by("at", "position").alias("last_at"),
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("position"))).alias("title"),
    )


def majority_repo(captures: DataFrame) -> DataFrame:
    """(conversation, repo): the most frequent last path segment of ``captures(conversation, position, repo)``; of equals the latest."""
    votes = captures.withColumn("repo", F.nullif(repo_leaf(F.col("repo")), F.lit(""))).filter("repo IS NOT NULL").groupBy("conversation", "repo").agg(F.count("*").alias("n"), F.max("position").alias("latest"))
    best = votes.groupBy("conversation").agg(F.max_by("repo", F.struct("n", "latest")).alias("repo"))
    return captures.select("conversation").distinct().join(best, "conversation", "left")


def repo_of_metadata(metadata: Column) -> Column:
    """The repository's name that a capture's metadata hold; null unless they are an object and it is a string."""
    value = F.try_variant_get(F.try_parse_json(metadata), "$.repo_name", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def pending(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("distilled_at").isNull())


def stamped(captures: DataFrame, snapshot: DataFrame, now: str) -> DataFrame:
    """Exactly the captures of a snapshot are distilled; what came later stays pending."""
    done = snapshot.select(F.col("id"), F.lit(True).alias("_done"))
    return captures.join(done, "id", "left").withColumn("distilled_at", F.when(F.col("_done"), F.lit(now)).otherwise(F.col("distilled_at"))).select(captures.columns)
