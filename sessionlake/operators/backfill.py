"""Backfill: which sessions to import, in which pages, and whether all is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.captures import insert_or_ignore, turns_of
from sessionlake.operators.jobs import counts, live_leases
from sessionlake.operators.order import row_numbers
from sessionlake.sources.transcripts import broken_files, existing, parse_errors, read_lines, records

#: Fixed values.
DEFAULT_CAP, CONFIRM_ABOVE, PAGE = 50, 200, 50


def snapshot(found: DataFrame, limit: int | None) -> DataFrame:
    """``found(path, modified)`` with ``rank`` from 1, the latest first, then by path, and whether it is ``selected``."""
    ranked = row_numbers(found, "rank", F.desc("modified"), "path")
    return ranked.withColumn("selected", F.lit(True) if limit is None else F.col("rank") <= limit)


def pages(ranked: DataFrame, size: int = PAGE) -> DataFrame:
    """Selected sessions with their ``page`` from 0."""
    return ranked.filter("selected").withColumn("page", F.floor((F.col("rank") - 1) / size))


def omitted_range(ranked: DataFrame) -> DataFrame:
    """(omitted, oldest, newest) of what was not selected; null ages if nothing."""
    return ranked.filter("NOT selected").agg(F.count("*").alias("omitted"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"))


def plan(total: int, limit: int | None, everything: bool, lane: str, confirmed: bool) -> dict:
    """How many sessions a run takes, or why it may not."""
    if everything and limit is not None:
        return {"error": "all and limit exclude each other"}
    if everything and lane not in ("api", "local"):
        return {"error": "all needs an API key or a local server"}
    count = total if everything else min(total, limit or DEFAULT_CAP)
    if lane == "api" and count > CONFIRM_ABOVE and not confirmed:
        return {"confirm": count}
    return {"count": count}


def rolled_up(results: DataFrame) -> DataFrame:
    """(inserted, failures, conversations, outcome) of ``results(page, inserted, failures, conversations)``; any failure makes it partial."""
    total = results.agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.flatten(F.array_sort(F.collect_list(F.struct("page", "failures")))["failures"]).alias("failures"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("conversations")))).alias("conversations"))
    return total.withColumn("outcome", F.when(F.size("failures") > 0, "partial").otherwise("complete"))


def report(ranked: DataFrame, captures: DataFrame) -> DataFrame:
    """(omitted, undistilled, complete): complete only if nothing is left out and nothing pending anywhere."""
    omitted = ranked.filter("NOT selected").agg(F.count("*").alias("omitted"))
    undistilled = captures.filter("distilled_at IS NULL").agg(F.count("*").alias("undistilled"))
    return omitted.join(F.broadcast(undistilled)).withColumn("complete", (F.col("omitted") == 0) & (F.col("undistilled") == 0))


def status(captures: DataFrame, notes: DataFrame, decisions: DataFrame, queue: DataFrame, now: object) -> DataFrame:
    """(counter, n): what a status report counts, each in one pass over its table."""
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    rows = counted(captures.filter("distilled_at IS NULL"), "undistilled").unionByName(counted(notes, "notes")).unionByName(counted(decisions, "decisions"))
    return rows.unionByName(live_leases(queue, now).select(F.lit("live leases").alias("counter"), F.col("live").alias("n"))).unionByName(counts(queue).select(F.concat(F.lit("jobs "), "status").alias("counter"), "n"))


def captured(turns: DataFrame, site: str, now: str, repos: DataFrame | None = None, *more: str) -> DataFrame:
    """Rows of the captures' table, of ``turns(session, source_key, prompt, response, model, cwd, at, offset)``; ids follow from their keys.

    ``repos(cwd, repo)`` tells the folders' repositories, which the captures' metadata then hold. ``more`` columns stay.
    """
    turns = turns.join(repos.select("cwd", "repo").dropDuplicates(["cwd"]), "cwd", "left") if repos is not None else turns.withColumn("repo", F.lit(None).cast("string"))
    return turns.select(
        F.sha2(F.to_json(F.struct(F.lit(site).alias("site"), "session", "source_key")), 256).alias("id"), F.lit(site).alias("site"), F.col("session").alias("conversation_id"),
        F.lit(None).cast("string").alias("conversation_title"), "prompt", "response", "model", F.to_json(F.struct(F.col("repo").alias("repo_name"))).alias("metadata"), "cwd", "source_key", F.col("at").alias("captured_at"), F.lit(now).alias("created_at"),
        F.lit(None).cast("string").alias("distilled_at"), F.col("offset").alias("seq"), *more,
    )


def imported(found: DataFrame, site: str, now: str, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(captures, parse errors) of whole sessions' records. Captures go in by key, so a session imported again adds nothing."""
    return captured(turns_of(found), site, now, repos), parse_errors(found)


def imported_page(files: DataFrame, found: DataFrame, broken: DataFrame, stored: DataFrame, site: str, now: str, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(captures to insert, results a page) of the pages' ``files(page, path)``, whose records are ``found``; for ``rolled_up``.

    Files are apart: a ``broken(path, error)`` one gives its error and no capture; one with bad records gives its good ones and how many
    were bad. Of captures with one key, none in ``stored``, the first by path goes in. Touched are the conversations that got any.
    """
    good = found.join(files.select("path"), "path", "left_semi").join(broken.select("path"), "path", "left_anti")
    new = insert_or_ignore(stored, captured(turns_of(good), site, now, repos, "path"), ["site", "conversation_id", "source_key"], ["path", "seq"])
    inserted = new.groupBy("path").agg(F.count("*").alias("inserted"), F.collect_set("conversation_id").alias("touched"))
    bad = parse_errors(good).select("path", F.concat(F.col("errors").cast("string"), F.lit(" malformed records")).alias("malformed"), F.col("errors").alias("parse_errors"))
    each = files.join(inserted, "path", "left").join(bad, "path", "left").join(broken.groupBy("path").agg(F.min("error").alias("error")), "path", "left")
    error = F.coalesce("error", "malformed")
    failure = F.when(error.isNotNull(), F.struct("path", error.alias("error"), "parse_errors"))
    results = each.groupBy("page").agg(
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.array_sort(F.collect_list(failure)).alias("failures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("conversations"),
    )
    return new.drop("path"), results


def import_page(spark: SparkSession, page: int, paths: list[str], stored: DataFrame, site: str, now: str, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``imported_page`` of one page's files, at most ``PAGE`` by default: any that is gone, or cannot be read to its end, fails alone."""
    names = existing(spark, paths)
    there = [p for p, name in names.items() if name]
    shown = spark.createDataFrame([(page, p, name) for p, name in names.items()], "page long, path string, name string")
    given = lambda df: df.withColumnRenamed("path", "name").join(shown.select("name", "path"), "name").drop("name")
    gone = shown.filter("name IS NULL").select("path", F.lit("no such file").alias("error"))
    empty = spark.createDataFrame([], "path string, offset long, line string")
    lines = given(read_lines(spark, *there, tolerant=True)).select("path", "offset", "line") if there else empty
    broken = gone.unionByName(given(broken_files(spark, *there)).select("path", "error")) if there else gone
    return imported_page(shown.drop("name"), records(lines), broken, stored, site, now, repos)
