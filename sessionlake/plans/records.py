"""Queries over whole tables for the record's keeping: notes, decisions and captures from their texts to stored rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.checkpoints import new_folder
from sessionlake.functions import chunks, text, vectors
from sessionlake.operators import backfill, captures, decisions, graph, jobs, notes, search
from sessionlake.plans.memory import LOG, NOW, PAIRED, SPACE, _scrubbed, conversation_records, hash_of, job_log, pair_turns, sessions
from sessionlake.plans.retrieval import FLOOR, LINKS, QUERY, RAIL, V, others, query_vector, threshold_links
from sessionlake.plans.retrieval import vectors as note_vectors
from sessionlake.plans.tables import table
from sessionlake.sources import repos, transcripts


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


# --- notes: parse, merge, sections, distil, upsert


def answers(spark, d) -> DataFrame:
    """A model's answer for each document: JSON with fields of right and wrong types, or no JSON object."""
    fields = F.to_json(F.struct(F.concat(F.lit("\t"), "source", F.lit(" ")).alias("topic"), F.col("doc_id").alias("summary"), F.col("text").alias("context"), F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.col("source")).alias("decisions"), F.col("lang").alias("tags")))
    return documents(spark, d).select("doc_id", "source", F.when(F.col("doc_id") % 10 == 3, F.lit("[]")).when(F.col("doc_id") % 10 == 4, F.col("text")).otherwise(fields).alias("answer"))


def parsed_notes(spark, d):
    n = answers(spark, d).select("doc_id", text.parse_note(F.col("answer")).alias("note"))
    return n.select("doc_id", F.col("note").isNotNull().alias("valid"), "note.topic", "note.summary", F.sha2("note.context", 256).alias("context_sha256"), F.array_join("note.decisions", "|").alias("decisions"), F.size("note.tags").cast("long").alias("tags"))


def merged_notes(spark, d):
    """Runs of five documents as the parts of one conversation."""
    part = F.struct(
        F.when(F.col("doc_id") % 5 < 2, F.lit(" ")).otherwise(F.col("source")).alias("topic"), F.when(F.col("doc_id") % 5 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), "lang")).alias("summary"), F.lit("\t").alias("context"),
        *(F.array("lang", F.concat(F.lit(" "), "source")).alias(f) if f == "decisions" else F.array(F.concat(F.col("source"), F.lit("\n"))).alias(f) for f, _ in text.SECTIONS), F.array(F.lit(" ")).alias("tags"),
    )
    parts = documents(spark, d).groupBy(F.floor(F.col("doc_id") / 5).alias("conversation")).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("n"))))["n"].alias("parts"))
    m = parts.select("conversation", text.merge_notes(F.col("parts")).alias("n"))
    return m.select("conversation", "n.topic", "n.summary", "n.context", F.array_join("n.decisions", "|").alias("decisions"), F.array_join("n.open_threads", "|").alias("open_threads"), F.size("n.tags").cast("long").alias("tags"))


def parsed_sections(spark, d):
    t = F.concat(
        F.lit("lead\n**Topic**: skipped\n**Context:** why "), F.col("source"), F.lit("\n**Decisions & Reasoning**:\n- keep "), F.col("lang"), F.lit("\n\n• "), F.col("source"), F.lit("\n**Strange**:\n– of "), F.col("lang"),
        F.lit("\n*open threads*:\n  "), F.col("doc_id").cast("string"), F.lit("\n**Decisions & Reasoning**\n- again"),
    )
    found = chunks.sections(documents(spark, d).select(F.col("doc_id").alias("id"), t.alias("text")))
    return found.select("id", "why", F.posexplode("sections").alias("nth", "s")).select("id", "why", "nth", "s.kind", F.array_join("s.bullets", "|").alias("bullets"))


def conversation_captures(spark, d) -> DataFrame:
    at = F.format_string("%08d", "position")
    return pair_turns(spark, d).select(
        F.concat_ws(":", "session", "position").alias("id"), F.lit("web").alias("site"), F.col("session").cast("string").alias("conversation_id"), F.when(F.col("position") % 4 == 1, F.concat(F.lit("title "), "position")).alias("conversation_title"),
        "prompt", "response", F.to_json(F.struct(F.regexp_replace("cwd", "^/work/", "org/").alias("repo_name"))).alias("metadata"), at.alias("captured_at"), at.alias("created_at"), F.when(F.col("position") % 3 == 0, F.lit("t")).alias("distilled_at"), F.col("position").alias("seq"),
    )


def measured(chunk: Column) -> Column:
    """A chat function that can be told in SQL: the chunk's length and its digest as a decision."""
    return F.to_json(F.struct(F.concat(F.lit("about "), F.length(chunk)).alias("topic"), F.array(F.md5(chunk), F.upper(F.md5(chunk))).alias("decisions"), F.array(F.lit(" t ")).alias("tags")))


def distilled_notes(spark, d):
    n, _ = notes.distilled(conversation_captures(spark, d), measured, "now", "m")
    return n.select("site", "conversation_id", "conversation_title", "turn_count", "topic", "compacted_text", F.array_join("entity_tags", ",").alias("tags"), "repo_name", "first_captured_at", "last_captured_at")


def distilled_decisions(spark, d):
    n, said = notes.distilled(conversation_captures(spark, d), measured, "now", "m")
    return said.join(n.select(F.col("id").alias("note_id"), "conversation_id"), "note_id").select("conversation_id", "text", F.col("ix").cast("long").alias("ix"), "content_hash")


def upserted_notes(spark, d):
    key = F.floor(F.col("doc_id") / 3)
    row = documents(spark, d).select(F.col("doc_id").alias("id"), F.when(key % 2 == 0, "web").otherwise("cli").alias("site"), key.alias("conversation_id"), F.col("source").alias("topic"), F.col("lang").alias("project_id"))
    return notes.upserted(row.filter("id % 3 = 0"), row.filter("id % 3 = 1 AND id % 2 = 0"))


def pending_captures(spark, d):
    c = conversation_captures(spark, d)
    stamped = captures.stamped(c, captures.pending(c).filter("seq % 2 = 1"), "now")
    return captures.pending(stamped).select("id", "conversation_id").unionByName(stamped.filter("distilled_at = 'now'").select("id", F.lit("stamped").alias("conversation_id")))


class Measures:
    """An embedder that can be told in SQL: a text's length and how many spaces it has."""

    id, dim = "measures", 2

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts], np.float32)


def reembedded_vectors(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    shadow = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.array(F.col("quality").cast("float"), F.lit(-1.0).cast("float")).alias("embedding"))
    whole = notes.require_vectors(rows.select("id"), notes.reembedded(rows, shadow, Measures()))
    return whole.select("id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


def reembed_resumed(spark, d):
    """A first run that saw even documents only, and one that no longer is there; a second one goes on from its shadow."""
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = new_folder(spark, "shadow")
    gone = rows.filter("id % 50 = 0").withColumn("id", -1 - F.col("id"))
    notes.reembed(rows.filter("id % 2 = 0").withColumn("text", F.concat("text", F.lit(" x"))).unionByName(gone), folder, Measures(), 4)
    return notes.reembed(rows, folder, Measures(), 4).select("id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


def truncated_tokens(spark, d):
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), F.length)
    t = notes.truncated(documents(spark, d).select(F.col("doc_id").alias("id"), ids.alias("ids"), F.transform(ids, lambda n: (n > 3).cast("int")).alias("mask")), 64)
    return t.select("id", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.aggregate("mask", F.lit(0), lambda s, m: s + m).cast("long").alias("kept"))


def pooled_vectors(spark, d):
    """Each vector as four tokens of 16 numbers, the last of which is masked in odd rows; in twentieths, as single precision allows."""
    v = note_vectors(spark, d)
    states = v.select("id", F.array(*(F.slice("v", 1 + 16 * i, 16) for i in range(4))).alias("states"), F.array(F.lit(1), F.lit(1), F.lit(1), (F.col("id") % 2 == 0).cast("int")).alias("mask"))
    return notes.pooled(states).select("id", F.posexplode("embedding").alias("place", "x")).select("id", "place", F.floor(F.col("x").cast("double") * 20 + 0.5).alias("x"))


# --- decisions: winner, ratification, receipt, listings, search rows


def statements(spark, d) -> DataFrame:
    """Pairs of vectors 0, 1 in each ten say the same, all others something of their own."""
    v = note_vectors(spark, d)
    said = F.when(v.id % 10 < 2, F.concat(F.lit("Use  "), F.floor(F.col("id") / 10))).otherwise(F.concat(F.lit("use no. "), "id"))
    return v.select("id", said.alias("text"), (F.col("id") * 31 % 97).alias("created_at"))


def same_length(a: Column, b: Column) -> Column:
    """A judge that can be told in SQL."""
    return F.length(a) == F.length(b)


def dedup_winner(spark, d):
    """Odd vectors as incoming decisions against all even ones."""
    s = statements(spark, d).join(note_vectors(spark, d).select("id", F.col("v").alias("embedding")), "id")
    found = decisions.dedup_candidates(s.filter("id % 2 = 1"), s.filter("id % 2 = 0"), RAIL, same_length)
    return found.select("incoming", "candidate", F.round("similarity", 6).alias("similarity"), "band", F.array_join(F.col("also").cast("array<string>"), ",").alias("also"))


def stored_decisions(spark, d) -> DataFrame:
    return documents(spark, d).filter("doc_id % 2 = 0").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Take "), F.floor(F.col("doc_id") / 4)).alias("decision_text"), F.lit(None).cast("string").alias("reason"), F.col("source").alias("topic"),
        text.content_hash(F.concat(F.lit("Take "), F.floor(F.col("doc_id") / 4))).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, "ratified").otherwise("distilled").alias("provenance"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("old")).alias("human_quote"), F.when(F.col("doc_id") % 10 == 0, "ledger").otherwise("local").alias("origin"),
        F.when(F.col("doc_id") % 7 != 0, F.format_string("d%05d", F.col("n_chars"))).alias("decided_at"), F.format_string("c%03d", F.col("doc_id") * 31 % 97).alias("created_at"),
    )


def ratifications(spark, d) -> decisions.Ratified:
    wanted = documents(spark, d).filter("doc_id % 2 = 1").select(
        F.format_string("w%09d", "doc_id").alias("id"), F.when(F.col("doc_id") % 8 == 5, F.concat(F.lit("New "), F.floor(F.col("doc_id") / 16))).otherwise(F.concat(F.lit(" TAKE  "), F.floor(F.col("doc_id") / 4))).alias("text"), F.lit("r").alias("reason"), F.col("lang").alias("topic"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("yes "), "doc_id")).alias("quote"), (F.col("doc_id") % 11 != 0).alias("confirmed"), F.when(F.col("doc_id") % 32 == 13, F.col("doc_id") - 1).alias("pick"),
    )
    stored = stored_decisions(spark, d).withColumn("id", F.format_string("s%09d", "id"))
    return decisions.ratified(stored, wanted.withColumn("pick", F.format_string("s%09d", "pick")), "now")


def ratify_outcomes(spark, d):
    return ratifications(spark, d).outcomes.select("id", "action", F.when(F.col("decision_id").startswith("s"), F.col("decision_id")).alias("decision_id"))


def ratified_decisions(spark, d):
    return ratifications(spark, d).decisions.select(F.when(F.col("provenance").isNotNull() & F.col("id").startswith("s"), F.col("id")).alias("id"), "decision_text", "topic", "content_hash", "provenance", "human_quote", "origin", "decided_at")


def secret_ratifications(spark, d) -> decisions.Ratified:
    """Statements with a secret in each field, of every document; those of every third are stored already, as scrubbed."""
    docs = documents(spark, d)
    word = F.sha2(F.col("doc_id").cast("string"), 224)
    wanted = docs.select(
        F.format_string("w%09d", "doc_id").alias("id"), F.concat(F.lit("Rule "), "doc_id", F.lit(": password: x"), word, F.lit(" stays")).alias("text"), F.concat(F.lit("as sk-"), word, F.lit(" says")).alias("reason"),
        F.concat(F.lit("api_key="), word).alias("topic"), F.concat(F.lit("yes, Bearer "), word, F.lit("!")).alias("quote"), F.lit(True).alias("confirmed"), F.lit(None).cast("string").alias("pick"),
    )
    measured = decisions.scrubbed(wanted).select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"))
    old = F.concat(F.lit("rule "), "doc_id", F.lit(": password: [redacted] stays"))
    stored = docs.filter("doc_id % 3 = 0").select(
        F.format_string("s%09d", "doc_id").alias("id"), old.alias("decision_text"), F.lit("old").alias("reason"), F.lit("old").alias("topic"), F.sha2(old, 256).alias("content_hash"), F.lit("distilled").alias("provenance"),
        F.lit(None).cast("string").alias("human_quote"), F.lit("local").alias("origin"), F.lit(None).cast("string").alias("decided_at"), F.lit("c").alias("created_at"),
    )
    return decisions.ratified(stored, wanted.join(measured, "id"), "now")


def ratify_scrubbed(spark, d):
    """What is stored of texts with secrets: nothing of them, and hashes and vectors are of the scrubbed texts."""
    found = secret_ratifications(spark, d)
    made = found.decisions.join(found.vectors, "id", "left")
    return made.select(F.regexp_extract("decision_text", "[0-9]+", 0).cast("long").alias("doc_id"), "decision_text", "reason", "topic", "human_quote", "content_hash", "provenance", F.col("embedding")[0].alias("measured"))


def ratify_ladder(spark, d):
    """Odd vectors are ratified against stored even ones: equal texts by similarity, others by the judge over all pairs."""
    v = note_vectors(spark, d).select("id", F.col("v").alias("embedding"))
    said = F.when(F.col("id") % 10 < 4, F.concat(F.lit("Use  "), F.floor(F.col("id") / 10))).otherwise(F.concat(F.lit("use no. "), "id"))
    name = lambda c: F.format_string("%06d", c)
    none = F.lit(None).cast("string")
    stored = v.filter("id % 2 = 0").select(
        name("id").alias("id"), said.alias("decision_text"), none.alias("reason"), none.alias("topic"), text.content_hash(said).alias("content_hash"), F.when(F.col("id") % 3 == 0, "ratified").otherwise("distilled").alias("provenance"), none.alias("human_quote"),
        F.when(F.col("id") % 14 == 0, "ledger").otherwise("local").alias("origin"), none.alias("decided_at"), name(F.col("id") * 31 % 97).alias("created_at"),
    )
    wanted = v.filter("id % 2 = 1").select(name("id").alias("id"), said.alias("text"), none.alias("reason"), none.alias("topic"), F.lit("yes").alias("quote"), (F.col("id") % 11 != 0).alias("confirmed"), "embedding")
    found = decisions.ratify(stored, v.filter("id % 2 = 0 AND id % 5 <> 4").select(name("id").alias("id"), "embedding"), wanted, RAIL, "now", same_length)
    return found.outcomes.select("id", "action", F.when(F.length("decision_id") == 6, F.col("decision_id")).alias("decision_id"))


def check_receipt(spark, d):
    found = decisions.check(others(spark, d).select("id"), others(spark, d), query_vector(spark, d), 0.2)
    return decisions.receipt(found, "a statement", "now", "receipt").withColumn("surfaced_ids", F.array_join("surfaced_ids", ","))


def decision_listing(spark, d):
    return decisions.listing(stored_decisions(spark, d)).select("id", "decision_text", "topic", "provenance", "decided_at")


def hydrated_search(spark, d):
    """Even vectors as notes, odd ones as decisions, with texts from the documents of the same number."""
    v, n = others(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("topic "), "label").alias("topic"))
    note = n.filter("id % 2 = 0").select("id", "topic", F.lit(None).cast("string").alias("summary"), F.concat(F.lit("note "), "id").alias("compacted_text"))
    decision = n.filter("id % 2 = 1").select("id", "topic", F.lit("why").alias("reason"), F.concat(F.lit("decision "), "id").alias("decision_text"), F.concat(F.lit("2024-"), "id").alias("decided_at"), F.lit("distilled").alias("provenance"))
    edges = threshold_links(spark, d).filter("a > 0 AND a % 2 = 0 AND b % 2 = 0")
    found = search.search(note, v.filter("id % 2 = 0"), decision, v.filter("id % 2 = 1"), edges, query_vector(spark, d), 50, floor=FLOOR)
    return search.hydrated(found, note, decision).withColumn("similarity", F.round("similarity", 6))


def shown_row(spark, d):
    """An id that a decision and a note have is the decision's."""
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "source")
    return decisions_or_notes(rows)


def decisions_or_notes(rows: DataFrame) -> DataFrame:
    old, new = rows.filter("id % 2 = 0"), rows
    found = [notes.shown(old, new, i).withColumn("asked", F.lit(i)) for i in (6, 7, -1)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("asked", "kind", F.get_json_object("row", "$.source").alias("source"))


def invalid_vectors(spark, d):
    v = note_vectors(spark, d)
    broken = F.when(v.id % 7 == 0, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(v.id % 7 == 1, F.slice("v", 1, 63)).when(v.id % 7 == 2, F.concat(F.slice("v", 1, 63), F.array(F.lit(None).cast("float")))).when(v.id % 7 == 3, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("-inf")).cast("float")))).otherwise(F.col("v"))
    return v.select("id", vectors.is_valid(broken, 64).alias("valid"))


def error_excerpts(spark, d):
    t = F.concat(F.lit("X-Api-Key: "), "source", F.lit("\nsaid "), "lang", F.lit(' and "'), "source", F.lit('" with BEARER '), "source", F.lit("\n\r\n"), F.coalesce("text", F.lit("")))
    return documents(spark, d).select("doc_id", text.safe_excerpt(t, ["fr", "src1", 'a"b']).alias("excerpt"))


def aliased_arguments(spark, d):
    c = table(spark, d, "conversations")
    first = text.first_statement(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\t"), "role")), F.when(F.col("turn") % 2 == 0, F.lit("\n ")).otherwise(F.concat(F.lit(" "), "text")), F.when(F.col("turn") % 4 == 2, F.col("text")))
    return c.select("conv_id", "turn", first.alias("statement"))


# --- captures: records, imports; queue; status


def record_lines(spark, d) -> DataFrame:
    """The conversations as lines of transcripts: a string or a list of blocks as content, broken lines among them."""
    c = conversation_records(spark, d).filter("role <> 'system'")
    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    body = F.when(F.col("position") % 4 < 2, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.struct(F.array(block("text", F.substring("text", 1, 7)), block("thinking", F.lit("x")), block("text", F.expr("substring(text, 8)"))).alias("content"))))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.col("session").cast("string").alias("sessionId"), F.concat_ws("-", "session", "position").alias("uuid"), "cwd", F.format_string("t%04d", "position").alias("timestamp")))
    line = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("head")), F.lit(',"message":'), F.col("body"), F.when(F.col("session") % 9 == 4, F.lit("")).otherwise(F.lit("}")))
    return c.withColumn("head", head).withColumn("body", body).select(F.concat(F.lit("s"), "session").alias("path"), F.col("position").alias("offset"), line.alias("line"))


def imported_captures(spark, d):
    rows, _ = backfill.imported(transcripts.records(record_lines(spark, d)), "cli", "now")
    return rows.select("site", "conversation_id", "source_key", "prompt", "response", "captured_at", "seq")


def backfill_page_results(spark, d):
    """Transcripts in pages of 50: some cannot be read, some have bad records, some captures are there already."""
    files = table(spark, d, "conversations").select("conv_id").distinct().select(F.floor(F.col("conv_id") / 50).alias("page"), F.concat(F.lit("s"), "conv_id").alias("path"))
    broken = files.filter(F.expr("cast(substring(path, 2) AS long) % 13 = 5")).select("path", F.lit("gone").alias("error"))
    found = transcripts.records(record_lines(spark, d))
    stored = backfill.captured(captures.turns_of(found), "cli", "then").filter("seq % 4 = 1 OR conversation_id % 3 = 0")
    _, results = backfill.imported_page(files, found, broken, stored, "cli", "now")
    return results.select("page", "inserted", F.to_json(F.transform("failures", lambda f: F.array(f.path, f.error))).alias("failures"), F.array_join("conversations", ",").alias("conversations"))


def folder_repos(spark, d):
    """Each document's folder, written in several ways, and its repository: of those within each other the innermost."""
    doc = documents(spark, d)
    up = F.when(F.col("doc_id") % 3 == 0, "/./").when(F.col("doc_id") % 3 == 1, "/x/../").otherwise("/")
    inner = F.concat(F.lit("/Work/"), "source", up, F.lit("P"), F.col("doc_id") % 7, F.lit("/in"), F.col("doc_id") % 4, F.lit("/deep"))
    cwd = F.when(F.col("doc_id") % 11 == 0, F.substring(inner, 2, 1000)).when(F.col("doc_id") % 11 != 1, inner)
    held = doc.select(F.concat(F.lit("/Work/"), "source").alias("path"), F.col("doc_id").alias("n"), "source")
    folders = held.filter("n % 20 < 19 AND source > 'src1'").select("path").unionByName(held.filter("n % 7 > 3").select(F.concat("path", F.lit("/P"), F.col("n") % 7).alias("path")))
    return repos.with_repo(doc.select("doc_id", cwd.alias("cwd")), folders).select("doc_id", "cwd", "repo")


def import_errors(spark, d):
    found = transcripts.records(record_lines(spark, d))
    return transcripts.merged_errors(transcripts.parse_errors(found), transcripts.parse_errors(found, 2))


def run_log(spark, d) -> DataFrame:
    body = F.to_json(F.struct(F.concat(F.lit("run"), F.col("user_id") % 5).alias("runJobId"), (F.col("event_id") % 4 * 50).alias("sliceStart")))
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "distill").otherwise("backfill-page").alias("kind"), body.alias("payload"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("last_error"), F.col("event_id").alias("seq"))


def run_pages(spark, d):
    return jobs.pages_of_run(run_log(spark, d), "run3", 100)


def reembed_barrier(spark, d):
    """With a re-embedding in the queue nothing else may start, and itself only when no lease is alive."""
    log = job_log(spark, d).withColumn("kind", F.when(F.col("id") % 100 == 7, "reembed").otherwise(F.col("kind")))
    early, late = (jobs.claimable(log, now).groupBy("kind").agg(F.count("*").alias("n")).withColumn("now", F.lit(now)) for now in (NOW, 1000))
    return early.unionByName(late)


def claim_transitions(spark, d):
    """The queue after each thing that may become of a claim, as counts; a claim of another epoch changes nothing."""
    log = job_log(spark, d)
    one = {"id": 211, "attempts": 1, "epoch": 1}
    after = {
        "claimed": jobs.claimed(log, NOW, 900), "renewed": jobs.renewed(log, one, 999, NOW), "completed": jobs.completed(log, one, NOW), "failed": jobs.failed(log, one, "e", NOW, 700), "fatal": jobs.failed(log, one, "e", NOW, 700, fatal=True),
        "rescheduled": jobs.rescheduled(log, one, 800, NOW), "given back": jobs.given_back(log, one, NOW), "stale": jobs.completed(log, {**one, "epoch": 7}, NOW),
    }
    rows = [df.agg(F.lit(name).alias("what"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "done").alias("done"), F.sum("attempts").alias("attempts"), F.sum("epoch").alias("epochs"), F.sum("lease_until").alias("leases"), F.sum("run_after").alias("due")) for name, df in after.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def status_counters(spark, d):
    return backfill.status(conversation_captures(spark, d), documents(spark, d), stored_decisions(spark, d), job_log(spark, d), NOW)


def session_counts(spark, d):
    """What remains of a snapshot by page."""
    return backfill.pages(sessions(spark, d), 50).groupBy("page").agg(F.count("*").alias("n"), F.max("modified").alias("newest"))


def project_changes(spark, d):
    v = table(spark, d, "embeddings")
    components = v.select(F.when(F.col("label") < 8, F.col("label").cast("long")).otherwise(F.col("vec_id") + 100).alias("component"), F.col("vec_id").alias("id"))
    projects = v.filter("label < 7 AND vec_id % 50 <> 3 OR label = 9").select(F.when(F.col("vec_id") % 40 == 2, (F.col("label") + 1) % 7).otherwise(F.col("label")).alias("project"), F.col("vec_id").alias("id"))
    return graph.changes(components, projects, v.select((F.col("label") * 2).alias("project")).distinct())


def fallback_names(spark, d):
    t = documents(spark, d)
    repo = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Org/"), F.upper("source"))).when(F.col("doc_id") % 3 == 1, F.lit(" "))
    return t.select("doc_id", graph.fallback_name(F.col("doc_id"), repo, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).when(F.col("doc_id") % 5 == 0, F.lit(""))).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        parsed_notes, merged_notes, parsed_sections, distilled_notes, distilled_decisions, upserted_notes, pending_captures, reembedded_vectors, reembed_resumed, backfill_page_results, folder_repos, truncated_tokens, pooled_vectors, dedup_winner, ratify_outcomes, ratified_decisions, ratify_scrubbed, ratify_ladder, check_receipt,
        decision_listing, hydrated_search, shown_row, invalid_vectors, error_excerpts, aliased_arguments, imported_captures, import_errors, run_pages, reembed_barrier, claim_transitions, status_counters, session_counts, project_changes, fallback_names,
    )
}

# --- the same in SQL


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


CAPTURES = f"""{PAIRED}, c AS (SELECT session, position, prompt, response, replace(cwd, '/work/', '') AS repo FROM turns)"""
SCRIPTS = f"""{CAPTURES}, w AS (SELECT session, string_agg('User:' || chr(10) || prompt || chr(10) || chr(10) || 'Assistant:' || chr(10) || response, chr(10) || chr(10) ORDER BY position) AS text FROM c GROUP BY 1),
s AS (SELECT session, {_scrubbed()} AS text FROM w)"""
STORED = f"""stored AS (SELECT printf('s%09d', doc_id) AS id, doc_id, 'Take ' || CAST(doc_id // 4 AS VARCHAR) AS decision_text, source AS topic, {hash_of("'Take ' || CAST(doc_id // 4 AS VARCHAR)")} AS content_hash,
  CASE WHEN doc_id % 3 = 0 THEN 'ratified' ELSE 'distilled' END AS provenance, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS human_quote, CASE WHEN doc_id % 10 = 0 THEN 'ledger' ELSE 'local' END AS origin,
  CASE WHEN doc_id % 7 <> 0 THEN printf('d%05d', n_chars) END AS decided_at, printf('c%03d', doc_id * 31 % 97) AS created_at FROM documents WHERE doc_id % 2 = 0)"""
ASKED = f"""asked AS (SELECT *, {hash_of("text")} AS content_hash FROM (SELECT printf('w%09d', doc_id) AS id, CASE WHEN doc_id % 8 = 5 THEN 'New ' || CAST(doc_id // 16 AS VARCHAR) ELSE ' TAKE  ' || CAST(doc_id // 4 AS VARCHAR) END AS text, lang AS topic,
  'yes ' || CAST(doc_id AS VARCHAR) AS quote, doc_id % 9 <> 0 AND doc_id % 11 <> 0 AS valid, CASE WHEN doc_id % 32 = 13 THEN printf('s%09d', doc_id - 1) END AS pick FROM documents WHERE doc_id % 2 = 1)),
won AS (SELECT a.*, coalesce(e.id, p.id) AS winner, coalesce(e.content_hash, p.content_hash) AS won_hash, coalesce(e.provenance, p.provenance) AS was FROM asked a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS rn FROM stored WHERE origin = 'local') e ON e.content_hash = a.content_hash AND e.rn = 1
  LEFT JOIN stored p ON p.id = a.pick AND p.origin = 'local'),
acts AS (SELECT *, CASE WHEN NOT valid THEN 'refuse' WHEN winner IS NULL THEN CASE WHEN id = min(CASE WHEN valid AND winner IS NULL THEN id END) OVER (PARTITION BY content_hash) THEN 'insert' ELSE 'keep' END
  WHEN won_hash <> content_hash THEN 'requote' WHEN was = 'distilled' THEN 'upgrade' ELSE 'keep' END AS action FROM won),
quotes AS (SELECT winner AS id, coalesce(max(CASE WHEN action = 'requote' THEN quote END), min_by(quote, id)) AS quote FROM (SELECT * FROM acts WHERE action IN ('upgrade', 'requote')) GROUP BY winner)"""
LINES = """said AS (SELECT * FROM turns WHERE session % 9 <> 4)"""

ORACLE_SQL = {
    "parsed_notes": f"""SELECT doc_id, doc_id % 10 NOT IN (3, 4) AS valid, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN source END AS topic, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN '' END AS summary,
  CASE WHEN doc_id % 10 NOT IN (3, 4) THEN sha256({trimmed("text")}) END AS context_sha256, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN lang || '|' || source END AS decisions, CASE WHEN doc_id % 10 NOT IN (3, 4) THEN 0 END AS tags FROM documents""",
    "merged_notes": """WITH p AS (SELECT doc_id // 5 AS conversation, doc_id, lang, source FROM documents),
said AS (SELECT conversation, x, min(nth) AS nth FROM (SELECT conversation, lang AS x, doc_id * 2 AS nth FROM p UNION ALL SELECT conversation, source, doc_id * 2 + 1 FROM p) GROUP BY 1, 2),
threads AS (SELECT conversation, source AS x, min(doc_id) AS nth FROM p GROUP BY 1, 2)
SELECT g.conversation, coalesce(min_by(source, doc_id) FILTER (WHERE doc_id % 5 >= 2), '') AS topic, coalesce(string_agg(lang, '; ' ORDER BY doc_id) FILTER (WHERE doc_id % 5 <> 1), '') AS summary, '' AS context,
  (SELECT string_agg(x, '|' ORDER BY nth) FROM said s WHERE s.conversation = g.conversation) AS decisions, (SELECT string_agg(x, '|' ORDER BY nth) FROM threads s WHERE s.conversation = g.conversation) AS open_threads, 0 AS tags FROM p g GROUP BY 1""",
    "parsed_sections": """SELECT doc_id AS id, 'why ' || source AS why, nth, kind, CASE nth WHEN 0 THEN 'lead|of ' || lang WHEN 1 THEN 'keep ' || lang || '|' || source || '|again' ELSE CAST(doc_id AS VARCHAR) END AS bullets
FROM documents, (VALUES (0, 'key_details'), (1, 'decisions'), (2, 'open_threads')) k(nth, kind)""",
    "distilled_notes": f"""WITH {SCRIPTS}, votes AS (SELECT session, repo, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, max(position) DESC) AS rn FROM c WHERE repo IS NOT NULL GROUP BY 1, 2),
g AS (SELECT session, count(*) AS n, min(position) AS lo, max(position) AS hi, max(CASE WHEN position % 4 = 1 THEN position END) AS titled FROM c GROUP BY 1)
SELECT 'web' AS site, CAST(s.session AS VARCHAR) AS conversation_id, 'title ' || CAST(titled AS VARCHAR) AS conversation_title, n AS turn_count, 'about ' || CAST(length(text) AS VARCHAR) AS topic,
  '**Topic**: about ' || CAST(length(text) AS VARCHAR) || chr(10) || chr(10) || '**Decisions & Reasoning**:' || chr(10) || '- ' || md5(text) || chr(10) || '- ' || upper(md5(text)) AS compacted_text, 't' AS tags, v.repo AS repo_name,
  printf('%08d', lo) AS first_captured_at, printf('%08d', hi) AS last_captured_at FROM s JOIN g ON g.session = s.session LEFT JOIN votes v ON v.session = s.session AND v.rn = 1""",
    "distilled_decisions": f"WITH {SCRIPTS} SELECT CAST(session AS VARCHAR) AS conversation_id, md5(text) AS text, 0 AS ix, sha256(md5(text)) AS content_hash FROM s",
    "upserted_notes": """WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id // 3 % 2 = 0 THEN 'web' ELSE 'cli' END AS site, doc_id // 3 AS conversation_id, source AS topic, lang AS project_id FROM documents)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.site, o.site) AS site, coalesce(n.conversation_id, o.conversation_id) AS conversation_id, CASE WHEN n.id IS NULL THEN o.topic ELSE n.topic END AS topic, CASE WHEN n.id IS NULL THEN o.project_id END AS project_id
FROM (SELECT * FROM r WHERE id % 3 = 0) o FULL JOIN (SELECT * FROM r WHERE id % 3 = 1 AND id % 2 = 0) n ON n.conversation_id = o.conversation_id""",
    "pending_captures": f"WITH {CAPTURES} SELECT CAST(session AS VARCHAR) || ':' || CAST(position AS VARCHAR) AS id, CASE WHEN position % 2 = 1 THEN 'stamped' ELSE CAST(session AS VARCHAR) END AS conversation_id FROM c WHERE position % 3 <> 0",
    "reembedded_vectors": """SELECT d.doc_id AS id, CAST(CASE WHEN l.doc_id IS NULL THEN length(coalesce(text, '')) ELSE l.quality END AS DOUBLE) AS first,
  CAST(CASE WHEN l.doc_id IS NULL THEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) ELSE -1 END AS DOUBLE) AS second FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "truncated_tokens": """WITH t AS (SELECT doc_id AS id, list_transform(string_split(coalesce(text, ''), ' ')[1:64], lambda w: length(w)) AS ids FROM documents)
SELECT id, len(ids) AS n, array_to_string(ids, ',') AS ids, len(list_filter(ids, lambda n: n > 3)) AS kept FROM t""",
    "pooled_vectors": f"""WITH {V}, m AS (SELECT id, list_transform(range(1, 17), lambda i: (e[i] + e[16 + i] + e[32 + i] + CASE WHEN id % 2 = 0 THEN e[48 + i] ELSE 0 END) / CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END) AS p FROM v)
SELECT id, CAST(a.place AS INTEGER) AS place, CAST(floor(p[a.place + 1] / sqrt(list_dot_product(p, p)) * 20 + 0.5) AS BIGINT) AS x FROM m, range(0, 16) a(place)""",
    "dedup_winner": f"""WITH {V}, said AS (SELECT id, e, CASE WHEN id % 10 < 2 THEN 'Use  ' || CAST(id // 10 AS VARCHAR) ELSE 'use no. ' || CAST(id AS VARCHAR) END AS text, id * 31 % 97 AS created_at FROM v),
pairs AS (SELECT n.id AS incoming, o.id AS candidate, list_cosine_similarity(n.e, o.e) AS sim, length(n.text) = length(o.text) AS alike, o.created_at, n.id % 10 = 1 AND o.id % 10 = 0 AND n.id // 10 = o.id // 10 AS same FROM said n JOIN said o ON n.id % 2 = 1 AND o.id % 2 = 0),
found AS (SELECT *, CASE WHEN same THEN 'exact' WHEN sim >= 0.4 THEN 'merge' ELSE 'judge' END AS band FROM pairs WHERE same OR (sim >= 0.4 OR (sim >= 0.3 AND alike)) AND incoming NOT IN (SELECT incoming FROM pairs WHERE same)),
placed AS (SELECT *, row_number() OVER (PARTITION BY incoming ORDER BY sim DESC, created_at, candidate) AS rn FROM found)
SELECT incoming, max(CASE WHEN rn = 1 THEN candidate END) AS candidate, round(max(CASE WHEN rn = 1 THEN sim END), 6) AS similarity, max(CASE WHEN rn = 1 THEN band END) AS band,
  coalesce(string_agg(CASE WHEN rn > 1 THEN CAST(candidate AS VARCHAR) END, ',' ORDER BY rn), '') AS also FROM placed GROUP BY 1""",
    "ratify_scrubbed": """WITH t AS (SELECT doc_id, 'ule ' || CAST(doc_id AS VARCHAR) || ': password: ' AS said, doc_id % 3 = 0 AS old FROM documents)
SELECT doc_id, CASE WHEN old THEN 'r' || said || '[redacted] stays' ELSE 'R' || said || '[REDACTED] stays' END AS decision_text, CASE WHEN old THEN 'old' ELSE 'as [REDACTED] says' END AS reason, CASE WHEN old THEN 'old' ELSE 'api_key=[REDACTED]' END AS topic,
  'yes, Bearer [REDACTED]!' AS human_quote, sha256('r' || said || '[redacted] stays') AS content_hash, 'ratified' AS provenance, CASE WHEN NOT old THEN CAST(length(said) + 17 AS DOUBLE) END AS measured FROM t""",
    "ratify_ladder": f"""WITH {V}, said AS (SELECT id, e, printf('%06d', id) AS name, CASE WHEN id % 10 < 4 THEN 'use ' || CAST(id // 10 AS VARCHAR) ELSE 'use no. ' || CAST(id AS VARCHAR) END AS text, CASE WHEN id % 10 < 4 THEN 1 ELSE 0 END AS wide, id * 31 % 97 AS created_at FROM v),
pairs AS (SELECT n.id, o.name AS other, o.id AS oid, n.text = o.text AS same, o.id % 5 <> 4 AS placed, CASE WHEN o.id % 5 <> 4 THEN list_cosine_similarity(n.e, o.e) ELSE 0 END AS sim, length(n.text) + n.wide = length(o.text) + o.wide AS alike, o.created_at
  FROM said n JOIN said o ON n.id % 2 = 1 AND o.id % 2 = 0 AND o.id % 14 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same DESC, sim DESC, created_at, other) AS rn FROM pairs WHERE same OR (placed AND sim >= 0.3 AND alike))
SELECT n.name AS id, CASE WHEN n.id % 11 = 0 THEN 'refuse' WHEN r.id IS NULL THEN CASE WHEN row_number() OVER (PARTITION BY n.text, n.id % 11 <> 0, r.id IS NULL ORDER BY n.id) = 1 THEN 'insert' ELSE 'keep' END WHEN NOT r.same THEN 'requote' WHEN r.oid % 3 <> 0 THEN 'upgrade' ELSE 'keep' END AS action,
  CASE WHEN n.id % 11 <> 0 THEN r.other END AS decision_id FROM said n LEFT JOIN ranked r ON r.id = n.id AND r.rn = 1 WHERE n.id % 2 = 1""",
    "ratify_outcomes": f"WITH {STORED}, {ASKED} SELECT id, action, CASE WHEN valid THEN winner END AS decision_id FROM acts",
    "ratified_decisions": f"""WITH {STORED}, {ASKED} SELECT s.id, decision_text, topic, content_hash, CASE WHEN q.id IS NOT NULL THEN 'ratified' ELSE provenance END AS provenance, coalesce(q.quote, human_quote) AS human_quote, origin, decided_at FROM stored s LEFT JOIN quotes q ON q.id = s.id
UNION ALL SELECT NULL, text, topic, content_hash, 'ratified', quote, 'local', 'now' FROM acts WHERE action = 'insert'""",
    "check_receipt": f"""WITH {V}, {QUERY} SELECT 'receipt' AS id, 'a statement' AS statement, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY sim DESC, id) FROM (SELECT * FROM q WHERE sim >= 0.2 ORDER BY sim DESC, id LIMIT 40)), '') AS surfaced_ids, 'now' AS surfaced_at""",
    "decision_listing": f"WITH {STORED} SELECT doc_id AS id, decision_text, topic, provenance, decided_at FROM stored",
    "hydrated_search": f"""WITH {LINKS}, {QUERY},
best AS (SELECT CASE WHEN y.id IS NULL THEN l.b ELSE l.a END AS id, max(l.similarity) AS similarity FROM links l LEFT JOIN anchors x ON x.id = l.a LEFT JOIN anchors y ON y.id = l.b
  WHERE l.a > 0 AND l.a % 2 = 0 AND l.b % 2 = 0 AND (x.id IS NULL) <> (y.id IS NULL) GROUP BY 1), capped AS (SELECT * FROM best ORDER BY similarity DESC, id LIMIT 400),
found AS (SELECT id, sim AS similarity, 'anchor' AS via, id % 2 = 0 AS note FROM anchors UNION ALL SELECT id, similarity, 'link', true FROM capped),
top AS (SELECT * FROM found ORDER BY similarity DESC, via, id LIMIT 50)
SELECT CASE WHEN note THEN 'note' ELSE 'decision' END AS kind, t.id, 'topic ' || repo AS topic, CASE WHEN NOT note THEN 'why' END AS summary, CASE WHEN note THEN 'note ' ELSE 'decision ' END || CAST(t.id AS VARCHAR) AS text, round(t.similarity, 6) AS similarity, via,
  CASE WHEN NOT note THEN '2024-' || CAST(t.id AS VARCHAR) END AS decided_at, CASE WHEN NOT note THEN 'distilled' END AS provenance FROM top t JOIN v ON v.id = t.id""",
    "shown_row": "SELECT CAST(doc_id AS INTEGER) AS asked, CASE WHEN doc_id % 2 = 0 THEN 'decision' ELSE 'note' END AS kind, source FROM documents WHERE doc_id IN (6, 7, -1)",
    "invalid_vectors": "SELECT vec_id AS id, vec_id % 7 > 3 AS valid FROM embeddings",
    "error_excerpts": """SELECT doc_id, substring(regexp_replace(replace(replace('X-Api-Key: [REDACTED]' || chr(10) || 'said ' || lang || ' and "' || source || '" with Bearer [REDACTED]' || chr(10) || coalesce(text, ''), 'fr', '[REDACTED]'), 'src1', '[REDACTED]'), '[\\r\\n]+', ' ', 'g'), 1, 512) AS excerpt FROM documents""",
    "aliased_arguments": f"""SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN role END, CASE WHEN turn % 2 = 1 THEN nullif({trimmed("text")}, '') END, CASE WHEN turn % 4 = 2 THEN nullif({trimmed("text")}, '') END) AS statement FROM conversations""",
    "imported_captures": f"""WITH {PAIRED}, {LINES} SELECT 'cli' AS site, CAST(session AS VARCHAR) AS conversation_id, CAST(session AS VARCHAR) || '-' || CAST(position AS VARCHAR) AS source_key, prompt, response, printf('t%04d', position) AS captured_at, position AS seq FROM said""",
    "reembed_resumed": """SELECT doc_id AS id, CAST(length(t) + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS first, CAST(length(t) - length(replace(t, ' ', '')) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS second
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "backfill_page_results": f"""WITH {PAIRED}, bad AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 9 = 4 AND role <> 'system' GROUP BY 1),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM conversations),
got AS (SELECT session, count(*) AS n FROM turns WHERE session % 9 <> 4 AND session % 13 <> 5 AND session % 3 <> 0 AND position % 4 <> 1 GROUP BY 1)
SELECT conv_id // 50 AS page, CAST(coalesce(sum(got.n), 0) AS BIGINT) AS inserted,
  '[' || coalesce(string_agg(CASE WHEN conv_id % 13 = 5 THEN '["s' || c || '","gone"]' WHEN bad.n > 0 THEN '["s' || c || '","' || CAST(bad.n AS VARCHAR) || ' malformed records"]' END, ',' ORDER BY 's' || c), '') || ']' AS failures,
  coalesce(string_agg(CASE WHEN got.n > 0 THEN c END, ',' ORDER BY c), '') AS conversations
FROM ids LEFT JOIN bad USING (conv_id) LEFT JOIN got ON got.session = conv_id GROUP BY 1""",
    "folder_repos": """WITH w AS (SELECT doc_id, source, '/Work/' || source AS base, 'P' || CAST(doc_id % 7 AS VARCHAR) AS p, '/in' || CAST(doc_id % 4 AS VARCHAR) || '/deep' AS rest FROM documents),
held AS (SELECT DISTINCT base AS path FROM w WHERE doc_id % 20 < 19 AND source > 'src1' UNION SELECT DISTINCT base || '/' || p FROM w WHERE doc_id % 7 > 3),
c AS (SELECT *, base || CASE doc_id % 3 WHEN 0 THEN '/./' WHEN 1 THEN '/x/../' ELSE '/' END || p || rest AS written, base || '/' || p || rest AS plain FROM w),
best AS (SELECT doc_id, max_by(path, length(path)) AS path FROM c JOIN held ON starts_with(plain || '/', path || '/') GROUP BY 1)
SELECT c.doc_id, CASE WHEN c.doc_id % 11 = 0 THEN substr(written, 2) WHEN c.doc_id % 11 <> 1 THEN written END AS cwd, CASE WHEN c.doc_id % 11 > 1 THEN lower(regexp_extract(best.path, '[^/]+$')) END AS repo FROM c LEFT JOIN best ON best.doc_id = c.doc_id""",
    "import_errors": "SELECT 's' || CAST(conv_id AS VARCHAR) AS path, count(*) + count(*) FILTER (WHERE turn >= 2) AS errors, max(turn) AS last_bad_offset FROM conversations WHERE conv_id % 9 = 4 AND role <> 'system' GROUP BY 1",
    "run_pages": """SELECT event_id AS id, 'backfill-page' AS kind, '{"runJobId":"run3","sliceStart":100}' AS payload, 'done' AS status, CAST(NULL AS VARCHAR) AS last_error FROM events WHERE event_id % 3 <> 0 AND user_id % 5 = 3 AND event_id % 4 = 2""",
    "reembed_barrier": f"""WITH {LOG}, waiting AS (SELECT * FROM log WHERE id % 100 = 7), free AS (SELECT t.now FROM (VALUES ({NOW}), (1000)) t(now) WHERE NOT EXISTS (SELECT 1 FROM log WHERE status = 'running' AND lease_until >= t.now)),
any_waiting AS (SELECT count(*) FILTER (WHERE status IN ('queued', 'running')) AS n FROM waiting)
SELECT 'reembed' AS kind, count(*) AS n, CAST(f.now AS INTEGER) AS now FROM waiting w JOIN free f ON (w.status = 'queued' OR (w.status = 'running' AND w.lease_until < f.now)) AND (w.run_after IS NULL OR w.run_after <= f.now) WHERE (SELECT n FROM any_waiting) > 0 GROUP BY f.now""",
    "claim_transitions": f"""WITH {LOG}, first AS (SELECT id AS chosen FROM log c WHERE (status = 'queued' OR (status = 'running' AND lease_until < {NOW})) AND (run_after IS NULL OR run_after <= {NOW})
  AND (kind <> 'distill' OR NOT EXISTS (SELECT 1 FROM log p WHERE p.id <> c.id AND p.kind = 'distill' AND p.status = 'running' AND p.lease_until >= {NOW} AND p.payload = c.payload)) ORDER BY created_at, seq LIMIT 1),
e(what, status, da, de, lease, due, clears) AS (VALUES ('claimed', 'running', 1, 0, 900, NULL, false), ('renewed', 'running', 0, 0, 999, NULL, false), ('completed', 'done', 0, 0, NULL, NULL, false), ('failed', 'queued', 0, 0, NULL, 700, true), ('fatal', 'failed', 0, 0, NULL, NULL, true),
  ('rescheduled', 'queued', -1, 1, NULL, 800, true), ('given back', 'queued', -1, 1, NULL, NULL, true), ('stale', NULL, 0, 0, NULL, NULL, false)),
x AS (SELECT e.*, log.*, CASE WHEN e.what = 'claimed' THEN log.id = (SELECT chosen FROM first) WHEN e.what = 'stale' THEN false ELSE log.id = 211 END AS hit FROM log, e)
SELECT what, count(*) FILTER (WHERE CASE WHEN hit THEN x.status ELSE x.status_1 END = 'queued') AS queued, count(*) FILTER (WHERE CASE WHEN hit THEN x.status ELSE x.status_1 END = 'running') AS running, count(*) FILTER (WHERE CASE WHEN hit THEN x.status ELSE x.status_1 END = 'done') AS done,
  sum(attempts + CASE WHEN hit THEN da ELSE 0 END) AS attempts, sum(epoch + CASE WHEN hit THEN de ELSE 0 END) AS epochs, sum(CASE WHEN hit THEN lease ELSE lease_until END) AS leases, sum(CASE WHEN hit AND clears THEN due ELSE run_after END) AS due FROM x GROUP BY 1""",
    "status_counters": f"""WITH {LOG}, {CAPTURES}, st(status) AS (VALUES ('queued'), ('running'), ('done'), ('failed')) SELECT 'jobs ' || st.status AS counter, count(log.id) AS n FROM st LEFT JOIN log ON log.status = st.status GROUP BY 1
UNION ALL SELECT 'undistilled', count(*) FROM c WHERE position % 3 <> 0 UNION ALL SELECT 'notes', count(*) FROM documents UNION ALL SELECT 'decisions', count(*) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'live leases', count(*) FROM log WHERE status = 'running' AND lease_until >= {NOW}""",
    "session_counts": "SELECT (r - 1) // 50 AS page, count(*) AS n, max(n_chars) AS newest FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 130 GROUP BY 1",
    "project_changes": """WITH a AS (SELECT label AS component, vec_id AS id, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label < 8),
b AS (SELECT *, count(*) OVER (PARTITION BY project) AS n FROM (SELECT CASE WHEN vec_id % 40 = 2 THEN (label + 1) % 7 ELSE label END AS project, vec_id AS id FROM embeddings WHERE label < 7 AND vec_id % 50 <> 3 OR label = 9)),
g AS (SELECT component, project, a.n AS x, b.n AS y, count(*) AS shared FROM a FULL JOIN b ON a.id = b.id GROUP BY 1, 2, 3, 4),
k AS (SELECT CASE WHEN project IS NULL THEN 'joined' WHEN component IS NULL THEN 'left' WHEN shared < x OR shared < y THEN 'parted' END AS change, CASE WHEN project IS NULL OR component IS NULL THEN shared ELSE 1 END AS n FROM g)
SELECT change, sum(n) AS n FROM (SELECT * FROM k WHERE change IS NOT NULL UNION ALL SELECT 'empty', count(*) FROM (SELECT DISTINCT label * 2 AS project FROM embeddings) WHERE project NOT IN (SELECT project FROM b)) WHERE n > 0 GROUP BY 1""",
    "fallback_names": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(source) || ': Sessions' WHEN doc_id % 2 = 0 THEN lang ELSE 'Project ' || CAST(doc_id + 1 AS VARCHAR) END AS name FROM documents""",
}
