"""Queries over conversations, documents and events: turns, notes, decisions, jobs and backfills."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import chunks, text
from sessionlake.operators import backfill, captures, decisions, graph, jobs
from sessionlake.plans.tables import table
from sessionlake.sources import transcripts

#: The log of events as a queue, in SQL that both engines read.
JOBS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'distill' WHEN 1 THEN 'distill' WHEN 2 THEN 'link-cluster' WHEN 3 THEN 'backfill' ELSE 'backfill-page' END AS kind,
  concat('{{"site":"', event_type, '","conversation_id":"', CAST(user_id AS STRING), '"}}') AS payload,
  CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'queued' ELSE 'done' END AS status,
  CAST(event_id % 6 AS INT) AS attempts, CAST(event_id % 3 AS INT) AS epoch, CAST(NULL AS STRING) AS last_error,
  CASE WHEN event_id % 3 <> 0 THEN event_id * 37 % 1000 END AS run_after, CASE WHEN event_id % 7 = 1 THEN event_id * 13 % 1000 END AS lease_until,
  event_id * 7919 % 10007 AS created_at, event_id AS updated_at, event_id AS seq FROM {events}"""
NOW = 600


def job_log(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(JOBS, events=table(spark, d, "events"))


def conversation_records(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", "text", F.when(F.col("role") == "user", F.concat(F.lit("/work/r"), (F.col("conv_id") % 7).cast("string"))).alias("cwd"))


def pair_turns(spark, d):
    return captures.pair_turns(conversation_records(spark, d)).select("session", "position", "prompt", "response", "cwd")


def exchanges(spark, d) -> DataFrame:
    return pair_turns(spark, d).select(
        F.col("session").alias("conversation"), "position", "prompt", "response", F.col("position").alias("at"), F.when(F.col("position") % 4 == 1, F.concat(F.lit("title "), F.col("position").cast("string"))).alias("title")
    )


def transcript_text(spark, d):
    return captures.transcript_text(exchanges(spark, d))


def conversation_stats(spark, d):
    return captures.conversation_stats(exchanges(spark, d))


def majority_repo(spark, d):
    e = table(spark, d, "events")
    path = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("C:\\Work\\"), F.upper("event_type"), F.lit("\\"))).when(F.col("event_id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("/work/"), F.col("event_type"), F.lit("/")))
    return captures.majority_repo(e.select(F.col("user_id").alias("conversation"), F.col("event_id").alias("position"), path.alias("repo")))


def content_hash_dedup(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def insert_or_ignore(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("site"), F.col("source").alias("conversation_id"), text.content_hash(F.col("text")).alias("source_key"))
    return captures.insert_or_ignore(t.filter("doc_id % 3 = 0"), t.filter("doc_id % 3 <> 0"), ["site", "conversation_id", "source_key"], ["doc_id"])


def parse_error_accounting(spark, d):
    kind = F.col("event_id") % 6
    session = F.col("user_id").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit('{"type":"assistant","sessionId":"'), session, F.lit('","message":{"content":"x"}}')))
        .when(kind == 1, F.lit('{"type":"user","message":'))
        .when(kind == 2, F.lit('{"type":"user","message":{"content":"x"}}'))
        .when(kind == 3, F.lit('{"type":"summary"}'))
        .when(kind == 4, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit('{"type":"user","sessionId":"'), session, F.lit('","message":{"content":[{"type":"text","text":"x"}]}}')))
    )
    lines = table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("offset"), line.alias("line"))
    return transcripts.parse_errors(transcripts.records(lines))


def repo_names(spark, d):
    name = F.concat(F.lit(" Org\\"), F.upper("lang"), F.lit("/"), F.initcap("source"), F.lit("/\t"))
    plain = table(spark, d, "documents").select(name.alias("raw")).distinct()
    return plain.select("raw", text.normalize_repo(F.col("raw")).alias("identity"), text.repo_leaf(F.col("raw")).alias("leaf"), text.repo_display(text.normalize_repo(F.col("raw"))).alias("display"))


def repo_prefix_names(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("cluster"), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("org/"), F.col("source"))).alias("repo"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" wrong: "), F.col("lang"))).when(F.col("doc_id") % 4 == 1, F.col("source")).when(F.col("doc_id") % 4 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit(" topics "))).alias("name"))
    return graph.prefixed_names(t).select("cluster", "name")


def scrub_redaction(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.scrub(F.col("text")).alias("scrubbed"), "text").filter("scrubbed <> text")
    return t.select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed_sha256"))


def render_sections(spark, d):
    none = F.array().cast("array<string>")
    note = F.struct(
        F.col("source").alias("topic"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("summary"), F.lit("").alias("context"), F.array("lang", "source").alias("key_details"),
        F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(none).alias("decisions"), none.alias("derived_conclusions"), none.alias("code_implementation"), none.alias("preferences_corrections"), F.array("lang").alias("open_threads"),
    )
    return table(spark, d, "documents").select("doc_id", text.render_note(note).alias("compacted_text"))


def chunk_sizes(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cut = chunks.chunks(t, 2000)
    joined = cut.groupBy("id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.array_join(F.array_sort(F.collect_list(F.struct("ix", "chunk")))["chunk"], "").alias("whole"))
    return joined.join(t, "id").select("id", "chunks", "longest", (F.col("whole") == F.col("text")).alias("lossless"))


def dominant_repo(spark, d):
    return graph.dominant_repo(repo_members(spark, d))


def repo_members(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.concat("lang", F.lit("-"), (F.col("doc_id") % 10).cast("string")).alias("cluster"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "source")).alias("repo"))


#: Names in the order in which people sort words.
WORDS = ("a_b", "ab", "Ábc", "é", "f", "zeta")


def repo_ties(spark, d):
    """Runs of documents whose repositories are all as frequent."""
    t = table(spark, d, "documents").filter("doc_id % 7 < 6")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.col("doc_id") * 5, F.lit(6)) + 1).cast("int"))
    return graph.dominant_repo(t.filter((F.col("doc_id") / 7).cast("long") % 6 <= F.col("doc_id") % 7).select(F.floor(F.col("doc_id") / 7).alias("cluster"), word.alias("repo")))


def repo_share_count(spark, d):
    return graph.sharing(dominant_repo(spark, d))


def decision_rows(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("note_id"), F.col("doc_id").alias("ix"), F.concat(F.lit(" Use "), F.col("source"), F.lit("  now"), F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("\t"))).alias("text"))


def distinct_decisions(spark, d):
    return decisions.distinct_decisions(decision_rows(spark, d))


def decision_reconcile(spark, d):
    hashed = decisions.distinct_decisions(decision_rows(spark, d))
    number = F.regexp_extract("text", r"(\d+)", 1).cast("int")
    stored = hashed.filter(number % 2 == 0).select("note_id", "content_hash", F.when(number % 3 == 0, "ratified").otherwise("distilled").alias("provenance"))
    return decisions.reconcile(stored, hashed.filter((number % 5 != 0) & (F.col("note_id") != "fr")))


def queue_counts(spark, d):
    return jobs.counts(job_log(spark, d))


def claim_order(spark, d):
    return jobs.claimable(job_log(spark, d), NOW).select("id", "kind", "created_at")


def claim_candidate(spark, d):
    return jobs.next_claim(job_log(spark, d), NOW).select("id", "kind", "attempts", "epoch")


def backoff_schedule(spark, d):
    return job_log(spark, d).filter("attempts > 0").groupBy("attempts").agg(F.count("*").alias("n")).withColumn("seconds", jobs.backoff_seconds(F.col("attempts")))


def coalesce_payload(spark, d):
    log = job_log(spark, d)
    return jobs.enqueued(log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1")).select("id", "kind", "payload")


def coalesce_conversation(spark, d):
    log = job_log(spark, d)
    return jobs.enqueued(log.filter("seq % 4 = 0 AND kind = 'distill'"), log.filter("seq % 4 <> 0 AND kind = 'distill'"), by_conversation=True).select("id", "payload")


def retry_failed(spark, d):
    return jobs.retried(job_log(spark, d), NOW).groupBy("status", "epoch").agg(F.count("*").alias("n"), F.max("attempts").alias("attempts"))


def next_wake(spark, d):
    return jobs.next_wake(job_log(spark, d))


def sessions(spark, d) -> DataFrame:
    return backfill.snapshot(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("modified")), 130)


def backfill_slices(spark, d):
    return backfill.pages(sessions(spark, d), 50).select("path", "rank", "page")


def omitted_age_range(spark, d):
    return backfill.omitted_range(sessions(spark, d))


def completeness_report(spark, d):
    return backfill.report(sessions(spark, d), table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("distilled_at")))


def run_roll_up(spark, d):
    pages = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("page")).agg(
        F.count("*").alias("inserted"), F.array_sort(F.collect_set(F.when((F.col("event_type") == "error") & (F.col("user_id") < 3), F.col("user_id").cast("string"))).cast("array<string>")).alias("failures"), F.array_sort(F.collect_set("event_type")).alias("conversations")
    )
    return backfill.rolled_up(pages).select("inserted", F.array_join("failures", ",").alias("failures"), F.array_join("conversations", ",").alias("conversations"), "outcome")


QUERIES = {
    f.__name__: f
    for f in (
        pair_turns, transcript_text, conversation_stats, majority_repo, content_hash_dedup, insert_or_ignore, parse_error_accounting, repo_names, repo_prefix_names, scrub_redaction, render_sections, chunk_sizes,
        dominant_repo, repo_share_count, repo_ties, distinct_decisions, decision_reconcile, queue_counts, claim_order, claim_candidate, backoff_schedule, coalesce_payload, coalesce_conversation, retry_failed, next_wake,
        backfill_slices, omitted_age_range, completeness_report, run_roll_up,
    )
}

# --- the same in SQL

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def hash_of(column: str) -> str:
    trimmed = f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"sha256(lower(regexp_replace({trimmed}, '{SPACE}+', ' ', 'g')))"


LOG = "log AS (" + JOBS.format(events="events") + ")"
PAIRED = """r AS (SELECT conv_id AS session, turn AS position, role, text, CASE WHEN role = 'user' THEN '/work/r' || CAST(conv_id % 7 AS VARCHAR) END AS cwd FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN {'text': text, 'cwd': cwd} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM r),
turns AS (SELECT session, position, coalesce(asked.text, '') AS prompt, text AS response, coalesce(cwd, asked.cwd) AS cwd FROM a WHERE role = 'assistant' AND text <> '' AND asked IS NOT NULL)"""
MEMBERS = "members AS (SELECT lang || '-' || CAST(doc_id % 10 AS VARCHAR) AS cluster, CASE WHEN doc_id % 2 = 0 THEN lower(source) WHEN doc_id % 9 = 0 THEN NULL ELSE lower(source) END AS repo FROM documents)"
DOMINANT = f"""WITH {MEMBERS}, votes AS (SELECT cluster, repo, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, repo) AS rn FROM members WHERE repo IS NOT NULL GROUP BY cluster, repo),
dominant AS (SELECT c.cluster, v.repo FROM (SELECT DISTINCT cluster FROM members) c LEFT JOIN votes v ON v.cluster = c.cluster AND v.rn = 1)"""
DECISIONS = f"""rows AS (SELECT lang AS note_id, doc_id AS ix, ' Use ' || source || '  now' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE chr(9) END AS text FROM documents),
h AS (SELECT note_id, {hash_of("text")} AS content_hash, arg_min(text, ix) AS text, min(ix) AS ix FROM rows GROUP BY 1, 2)"""
RANKED = "ranked AS (SELECT doc_id AS path, n_chars AS modified, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"
CLAIMABLE = f"""claimable AS (SELECT * FROM log c WHERE (status = 'queued' OR (status = 'running' AND lease_until < {NOW})) AND (run_after IS NULL OR run_after <= {NOW})
  AND (kind <> 'distill' OR NOT EXISTS (SELECT 1 FROM log p WHERE p.id <> c.id AND p.kind = 'distill' AND p.status = 'running' AND p.lease_until >= {NOW} AND p.payload = c.payload)))"""


def _scrubbed() -> str:
    out = "text"
    for pattern, replacement, _ in text.SCRUB_RULES:
        quoted = pattern.replace("'", "''")
        into = re.sub(r"\$(\d)", r"\\\1", replacement)
        out = f"regexp_replace({out}, '{quoted}', '{into}', 'g')"
    return out


ORACLE_SQL = {
    "chunk_sizes": """WITH RECURSIVE l AS (SELECT doc_id, ix, length(x) + CASE WHEN ix < n THEN 1 ELSE 0 END AS w, n FROM
  (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS ix, len(p) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
s AS (SELECT doc_id, 0::BIGINT AS ix, 0::BIGINT AS done, 0::BIGINT AS held, 0::BIGINT AS longest, 1::BIGINT AS n FROM l WHERE ix = 1
  UNION ALL SELECT s.doc_id, l.ix,
    s.done + CASE WHEN s.held > 0 AND s.held + l.w > 2000 THEN 1 ELSE 0 END + CASE WHEN l.w > 2000 THEN (l.w - 1) // 2000 ELSE 0 END,
    CASE WHEN l.w > 2000 THEN l.w - (l.w - 1) // 2000 * 2000 WHEN s.held + l.w > 2000 THEN l.w ELSE s.held + l.w END,
    greatest(s.longest, CASE WHEN s.held + l.w > 2000 THEN s.held ELSE 0 END, CASE WHEN l.w > 2000 THEN 2000 ELSE 0 END), l.n
  FROM s JOIN l ON l.doc_id = s.doc_id AND l.ix = s.ix + 1)
SELECT doc_id AS id, CASE WHEN done = 0 OR held > 0 THEN done + 1 ELSE done END AS chunks, CAST(greatest(longest, held) AS INTEGER) AS longest, true AS lossless FROM s WHERE ix = n AND ix > 0""",
    "pair_turns": f"WITH {PAIRED} SELECT * FROM turns",
    "transcript_text": f"WITH {PAIRED} SELECT session AS conversation, string_agg('User:' || chr(10) || prompt || chr(10) || chr(10) || 'Assistant:' || chr(10) || response, chr(10) || chr(10) ORDER BY position) AS transcript FROM turns GROUP BY 1",
    "conversation_stats": f"""WITH {PAIRED} SELECT session AS conversation, count(*) AS turn_count, min(position) AS first_at, max(position) AS last_at,
  'title ' || CAST(max(CASE WHEN position % 4 = 1 THEN position END) AS VARCHAR) AS title FROM turns GROUP BY 1""",
    "majority_repo": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS repo FROM events),
v AS (SELECT user_id, repo, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(event_id) DESC) AS rn FROM e WHERE repo IS NOT NULL GROUP BY 1, 2)
SELECT c.user_id AS conversation, v.repo FROM (SELECT DISTINCT user_id FROM e) c LEFT JOIN v ON v.user_id = c.user_id AND rn = 1""",
    "content_hash_dedup": f"SELECT {hash_of('text')} AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "insert_or_ignore": f"""WITH t AS (SELECT doc_id, lang AS site, source AS conversation_id, {hash_of("text")} AS source_key FROM documents)
SELECT min(doc_id) AS doc_id, site, conversation_id, source_key FROM t n WHERE doc_id % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id % 3 = 0 AND o.site = n.site AND o.conversation_id = n.conversation_id AND o.source_key = n.source_key) GROUP BY 2, 3, 4""",
    "parse_error_accounting": "SELECT event_type AS path, count(*) AS errors, max(event_id) AS last_bad_offset FROM events WHERE event_id % 6 IN (0, 1, 2) GROUP BY 1",
    "repo_names": r"""SELECT DISTINCT ' Org\' || upper(lang) || '/' || upper(source[1]) || source[2:] || '/' || chr(9) AS raw, 'org\' || lang || '/' || source || '/' AS identity, source AS leaf, source AS display FROM documents""",
    "repo_prefix_names": """SELECT doc_id AS cluster, CASE
  WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN ' wrong: ' || lang WHEN 1 THEN source WHEN 2 THEN '  ' ELSE ' ' || lang || ' topics ' END
  WHEN doc_id % 4 IN (1, 2) THEN source WHEN doc_id % 4 = 0 THEN source || ': ' || lang ELSE source || ': ' || lang || ' topics' END AS name FROM documents""",
    "scrub_redaction": f"SELECT doc_id, sha256({_scrubbed()}) AS scrubbed_sha256 FROM documents WHERE {_scrubbed()} <> text",
    "render_sections": """SELECT doc_id, '**Topic**: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '**One-line summary**: ' || lang ELSE '' END
  || chr(10) || chr(10) || '**Key Details**:' || chr(10) || '- ' || lang || chr(10) || '- ' || source
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '**Decisions & Reasoning**:' || chr(10) || '- ' || source ELSE '' END
  || chr(10) || chr(10) || '**Open Threads**:' || chr(10) || '- ' || lang AS compacted_text FROM documents""",
    "dominant_repo": f"{DOMINANT} SELECT cluster, repo FROM dominant",
    "repo_ties": f"SELECT doc_id // 7 AS cluster, lower(list_extract({list(WORDS)}, min(doc_id * 5 % 6) + 1)) AS repo FROM documents WHERE doc_id % 7 < 6 AND doc_id // 7 % 6 <= doc_id % 7 GROUP BY 1",
    "repo_share_count": f"{DOMINANT} SELECT cluster, repo, count(*) OVER (PARTITION BY repo) AS sharing FROM dominant",
    "distinct_decisions": f"WITH {DECISIONS} SELECT note_id, content_hash, text, ix FROM h",
    "decision_reconcile": f"""WITH {DECISIONS}, k AS (SELECT *, CAST(regexp_extract(text, '(\\d+)', 1) AS INTEGER) AS number FROM h),
s AS (SELECT note_id, content_hash, CASE WHEN number % 3 = 0 THEN 'ratified' ELSE 'distilled' END AS provenance FROM k WHERE number % 2 = 0 AND note_id <> 'fr'),
f AS (SELECT note_id, content_hash FROM k WHERE number % 5 <> 0 AND note_id <> 'fr')
SELECT coalesce(s.note_id, f.note_id) AS note_id, coalesce(s.content_hash, f.content_hash) AS content_hash,
  CASE WHEN s.provenance IS NULL THEN 'insert' WHEN s.provenance = 'ratified' OR f.note_id IS NOT NULL THEN 'keep' ELSE 'delete' END AS action
FROM s FULL JOIN f ON s.note_id = f.note_id AND s.content_hash = f.content_hash""",
    "queue_counts": f"WITH {LOG}, s(status) AS (VALUES ('queued'), ('running'), ('done'), ('failed')) SELECT s.status, count(log.id) AS n FROM s LEFT JOIN log ON log.status = s.status GROUP BY 1",
    "claim_order": f"WITH {LOG}, {CLAIMABLE} SELECT id, kind, created_at FROM claimable",
    "claim_candidate": f"WITH {LOG}, {CLAIMABLE} SELECT id, kind, attempts, epoch FROM claimable ORDER BY created_at, seq LIMIT 1",
    "backoff_schedule": f"WITH {LOG} SELECT attempts, count(*) AS n, CAST(least(1800, 30 * power(2, attempts - 1)) AS BIGINT) AS seconds FROM log WHERE attempts > 0 GROUP BY 1",
    "coalesce_payload": f"""WITH {LOG} SELECT min(id) AS id, kind, payload FROM log n WHERE seq % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM log o WHERE o.seq % 2 = 0 AND o.status = 'queued' AND o.kind = n.kind AND o.payload = n.payload) GROUP BY 2, 3""",
    "coalesce_conversation": f"""WITH {LOG} SELECT min(id) AS id, payload FROM log n WHERE seq % 4 <> 0 AND kind = 'distill'
  AND NOT EXISTS (SELECT 1 FROM log o WHERE o.seq % 4 = 0 AND o.kind = 'distill' AND o.status = 'queued' AND o.payload = n.payload) GROUP BY 2""",
    "retry_failed": f"""WITH {LOG}, x AS (SELECT CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' THEN epoch + 1 ELSE epoch END AS epoch, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM log)
SELECT status, epoch, count(*) AS n, max(attempts) AS attempts FROM x GROUP BY 1, 2""",
    "next_wake": f"WITH {LOG} SELECT min(CASE status WHEN 'queued' THEN run_after WHEN 'running' THEN lease_until END) AS wake FROM log",
    "backfill_slices": f"WITH {RANKED} SELECT path, rank, CAST(floor((rank - 1) / 50) AS BIGINT) AS page FROM ranked WHERE rank <= 130",
    "omitted_age_range": f"WITH {RANKED} SELECT count(*) AS omitted, min(modified) AS oldest, max(modified) AS newest FROM ranked WHERE rank > 130",
    "completeness_report": f"WITH {RANKED}, o AS (SELECT count(*) AS omitted FROM ranked WHERE rank > 130), u AS (SELECT count(*) AS undistilled FROM events WHERE event_id % 3 <> 0) SELECT omitted, undistilled, omitted = 0 AND undistilled = 0 AS complete FROM o, u",
    "run_roll_up": """WITH f AS (SELECT DISTINCT user_id % 20 AS page, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_type = 'error' AND user_id < 3)
SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS inserted, coalesce((SELECT string_agg(u, ',' ORDER BY page, u) FROM f), '') AS failures,
  (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events)) AS conversations, CASE WHEN (SELECT count(*) FROM f) > 0 THEN 'partial' ELSE 'complete' END AS outcome""",
}
