from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import notes
from sessionlake.operators.captures import turns_of
from sessionlake.schemas import TABLES
from sessionlake.sources import store, transcripts
from sessionlake.streaming import ingest


def record(kind, session, content, uuid=None, **more):
    return json.dumps({"type": kind, "sessionId": session, "message": {"content": content, "model": "m"}, **({"uuid": uuid} if uuid else {}), **({"timestamp": "t"} if kind == "assistant" else {}), **more})


def write(path, *lines, end="\n"):
    path.write_bytes(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + end.encode())
    return str(path)


def turns(spark, path, start=0):
    found = transcripts.records(transcripts.read_lines(spark, path))
    return [(r["session"], r["prompt"], r["response"]) for r in turns_of(found, start).orderBy("offset").collect()], transcripts.parse_errors(found).collect()


def test_offsets():
    data = b"ab\ncd\nopen"
    assert [transcripts.check_offset(data, o) for o in (0, 3, 6)] == [0, 3, 6] and transcripts.next_offset(data) == 6
    for bad in (-1, 0.5, float("nan"), float("inf"), 1, 99, True, None):
        with pytest.raises(transcripts.OffsetError):
            transcripts.check_offset(data, bad)
    assert list(transcripts.complete_lines(b"a\xff\nb")) == [(0, "a�")]
    assert transcripts.read_checkpoint(None, 5) == 0 and transcripts.read_checkpoint('{"offset": 3}', 5) == 3
    for bad in ('{"offset": 9}', '{"offset": -1}', '{"offset": "3"}'):
        with pytest.raises(transcripts.OffsetError):
            transcripts.read_checkpoint(bad, 5)


def test_interleaved_sessions_and_text_blocks(spark, tmp_path):
    path = write(
        tmp_path / "a.jsonl", record("user", "s1", "a"), record("user", "s2", [{"type": "text", "text": "one"}, {"type": "image", "text": "no"}, {"type": "text", "text": "two"}, {"type": "text", "text": 3}]),
        record("assistant", "s2", "B", "u2"), record("assistant", "s1", "A"), record("assistant", "s3", "orphan"), '{"half":', end="",
    )
    got, errors = turns(spark, path)
    assert got == [("s2", "onetwo", "B"), ("s1", "a", "A")] and errors == []


def test_errors_are_counted_where_they_begin(spark, tmp_path):
    odd = ["null", "[]", "42", "{}", '{"type":"user"}', '{"type":"assistant","sessionId":"s","message":{}}']
    got, errors = turns(spark, write(tmp_path / "b.jsonl", *odd))
    assert got == [] and [(r["errors"], r["last_bad_offset"]) for r in errors] == [(2, sum(len(x) + 1 for x in odd[:5]))]
    first = record("user", "s", "q")
    got, errors = turns(spark, write(tmp_path / "c.jsonl", first, "{bad", record("assistant", "s", "r")))
    assert got == [("s", "q", "r")] and errors[0]["last_bad_offset"] == len(first) + 1


def test_users_without_text_are_answered_too(spark, tmp_path):
    lines = [record("user", "s", "look it up"), record("assistant", "s", "calling"), record("user", "s", [{"type": "tool_result", "content": "7"}]), record("assistant", "s", "seven"), record("assistant", "t", "nobody asked")]
    got, _ = turns(spark, write(tmp_path / "tool.jsonl", *lines))
    assert got == [("s", "look it up", "calling"), ("s", "", "seven")]


def test_errors_before_a_delta_are_not_counted_again(spark, tmp_path):
    found = transcripts.records(transcripts.read_lines(spark, write(tmp_path / "e.jsonl", "{one", "{two", record("user", "s", "q"))))
    assert [r["errors"] for r in transcripts.parse_errors(found).collect()] == [2] and [(r["errors"], r["last_bad_offset"]) for r in transcripts.parse_errors(found, 5).collect()] == [(1, 5)]


def rows_of(content: bytes) -> list[tuple]:
    return list(transcripts.complete_lines(content))


def test_a_file_is_read_by_many_tasks_with_the_same_offsets(spark, tmp_path):
    lines = [(b"x" * (i * 37 % 900)) + (b"\xff\xc3\xa9\r" if i % 5 == 0 else b"") for i in range(6000)] + [b"", b"y" * 300_000, b""]
    contents = {"long.jsonl": b"\n".join(lines) + b"\nopen", "one.jsonl": b"\n", "open.jsonl": b"no end", "none.jsonl": b"", "a b.jsonl": b"q\n\n"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = transcripts.read_lines(spark, str(tmp_path))
        got = found.collect()
        assert found.rdd.getNumPartitions() > 1
        whole = spark.read.format("text").option("lineSep", "\n").load(str(tmp_path / "long.jsonl"))
        assert whole.rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, content in contents.items():
        assert sorted((r["offset"], r["line"]) for r in got if r["path"].replace("%20", " ").endswith("/" + name)) == rows_of(content), name
    ends = {r["path"].rsplit("/", 1)[1]: r["offset"] for r in transcripts.checkpoints(found).collect()}
    assert ends["long.jsonl"] == transcripts.next_offset(contents["long.jsonl"]) and set(ends) == {"long.jsonl", "one.jsonl", "a%20b.jsonl"}


def test_reading_goes_on_from_a_checkpoint(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_bytes(b"one\ntw\xff\nthr")
    first = transcripts.read_lines(spark, str(path))
    assert [(r["offset"], r["line"]) for r in first.orderBy("offset").collect()] == [(0, "one"), (4, "tw\ufffd")]
    at = spark.createDataFrame(transcripts.checkpoints(first).collect())
    path.write_bytes(b"one\ntw\xff\nthree\nfour\n")
    assert [(r["offset"], r["line"]) for r in transcripts.read_lines(spark, str(path), starts=at).orderBy("offset").collect()] == [(8, "three"), (14, "four")]
    end = transcripts.checkpoints(transcripts.read_lines(spark, str(path)))
    assert transcripts.read_lines(spark, str(path), starts=end).count() == 0
    for bad in (1, 5, 99, -1):
        with pytest.raises(Exception, match="not the start of a record"):
            transcripts.read_lines(spark, str(path), starts=at.withColumn("offset", F.lit(bad))).count()
    assert transcripts.read_lines(spark, str(path), starts=at.withColumn("offset", F.lit(0))).count() == 4


def test_the_last_record_is_found_from_the_end(tmp_path):
    path = tmp_path / "long.jsonl"
    for content in (b"", b"open", b"a\n", b"a\n" + b"x" * 500, b"y" * 300 + b"\n" + b"z" * 64 + b"\n" + b"open"):
        path.write_bytes(content)
        for block in (1, 7, 64, 1 << 16):
            assert ingest.last_record(str(path), block) == transcripts.next_offset(content)


def test_a_file_that_became_shorter_is_an_error():
    reader = ingest.TranscriptReader("unused")
    assert [(s.path, s.start, s.end) for s in reader.partitions({"a": 3}, {"a": 9, "b": 4})] == [("a", 3, 9), ("b", 0, 4)]
    with pytest.raises(transcripts.OffsetError):
        reader.partitions({"a": 9}, {"a": 3})


def test_a_delta_has_earlier_users_as_context(spark, tmp_path):
    first = record("user", "s", "q")
    path = write(tmp_path / "d.jsonl", first, record("assistant", "s", "r"))
    assert turns(spark, path, len(first) + 1)[0] == [("s", "q", "r")]


def test_discovery(spark, tmp_path):
    write(tmp_path / "a.jsonl", "{}")
    for folder in ("x", "x/y"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "b.jsonl", "{}")
    found = [r["path"].split("/")[-2:] for r in transcripts.discover(spark, str(tmp_path)).collect()]
    assert sorted(f[-1] for f in found) == ["a.jsonl", "b.jsonl"]
    assert transcripts.discover(spark, str(tmp_path / "none")).count() == 0


def test_stream_resumes_and_never_repeats(spark, tmp_path):
    root, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    root.mkdir()
    user, answer = record("user", "s", "q", cwd="/w/app"), record("assistant", "s", "r1")
    path = root / "a.jsonl"
    path.write_text(user + "\n" + answer + "\n" + "{bad\n" + record("user", "t", "only asks") + "\n" + '{"type":')
    repos = spark.createDataFrame([("/w/app", "org/app")], "cwd string, repo string")
    sink = ingest.Sink(str(tmp_path / "out"), "r", "cli", lambda: "now", repos)
    ingest.capture(spark, str(root), checkpoint, sink).awaitTermination()
    assert [(r["response"], r["metadata"]) for r in sink.captures(spark).collect()] == [("r1", '{"repo_name":"org/app"}')]
    assert [(r["errors"], r["last_bad_offset"]) for r in sink.errors(spark).collect()] == [(1, len(user) + len(answer) + 2)]
    assert [json.loads(r["payload"]) for r in sink.jobs(spark).collect()] == [{"site": "cli", "conversation_id": "s"}]
    more = [record("assistant", "s", "r2", "u"), "{worse", record("assistant", "s", "again", "u"), record("assistant", "o", "nobody asked")]
    path.write_text(user + "\n" + answer + "\n" + "{bad\n" + record("user", "t", "only asks") + "\n" + "\n".join(more) + "\n")
    for _ in range(2):
        ingest.capture(spark, str(root), checkpoint, sink).awaitTermination()
    (root / "b.jsonl").write_text(record("assistant", "s", "a copy", "u") + "\n" + record("assistant", "t", "late", "v") + "\n")
    ingest.capture(spark, str(root), checkpoint, sink).awaitTermination()
    got = sink.captures(spark).orderBy("created_at", "conversation_id", "seq").collect()
    assert [(r["conversation_id"], r["prompt"], r["response"], r["source_key"]) for r in got] == [("s", "q", "r1", str(len(user) + 1)), ("s", "q", "r2", "u"), ("t", "only asks", "late", "v")]
    assert [r["errors"] for r in sink.errors(spark).collect()] == [2]
    assert sorted(json.loads(r["payload"])["conversation_id"] for r in sink.jobs(spark).collect()) == ["s", "s", "t"]
    note, _ = notes.distilled(sink.captures(spark), lambda chunk: F.lit('{"topic": "t"}'), "now", "m")
    assert sorted((r["conversation_id"], r["turn_count"], r["repo_name"]) for r in note.collect()) == [("s", 2, "app"), ("t", 1, None)]


def test_a_batch_that_is_run_again_adds_nothing_and_reads_no_other(spark, tmp_path):
    event = lambda kind, session, at: (kind, session, f"k{at}", "q", "r", None, None, "t", "p", at)
    batches = [[event("turn", "s", 1), event("error", None, 2)], [event("turn", "s", 3), event("turn", "u", 4)], []]
    sink = ingest.Sink(str(tmp_path / "out"), "r", clock=lambda: "now")
    for number in (0, 1, 1, 0, 2):
        sink(spark.createDataFrame(batches[number], ingest.EVENTS), number)
    assert sorted(r["source_key"] for r in sink.captures(spark).collect()) == ["k1", "k3", "k4"]
    assert [tuple(r) for r in sink.errors(spark).collect()] == [("p", 1, 2)] and sink.jobs(spark).count() == 3
    broken = tmp_path / "out" / "captures" / "batch=r-000000000"
    for f in broken.glob("part-*"):
        f.write_bytes(b"unreadable")
    sink(spark.createDataFrame(batches[1], ingest.EVENTS), 3)  # would fail if it looked at earlier parts


def test_only_changed_files_are_opened(tmp_path, monkeypatch):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("{}\n")
    reader, opened = ingest.TranscriptReader(str(tmp_path)), []
    real = ingest.last_record
    monkeypatch.setattr(ingest, "last_record", lambda path: opened.append(path) or real(path))
    assert {*reader.latestOffset().values()} == {3} and len(opened) == 2
    (tmp_path / "a.jsonl").write_text("{}\n{}\n")
    assert sorted(reader.latestOffset().values()) == [3, 6] and len(opened) == 3
    reader.latestOffset()
    assert len(opened) == 3


def test_store_publishes_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    start = s.open()
    p = spark.createDataFrame([("1", "Theme", "t")], "id string, name string, created_at string")
    links = spark.createDataFrame([("a", "b", 1.0, "t")], "a string, b string, similarity double, computed_at string")
    one = s.commit(start, {"projects": p, "links": links}, {"model": "m"})
    assert s.table("projects").count() == 1 and s.table("projects", start).count() == 0 and s.open().meta == {"model": "m"}
    with pytest.raises(store.Conflict):
        s.commit(start, {"links": links})
    with pytest.raises(store.Conflict):
        s.commit(one, {"links": links.limit(0)}, fence=lambda: False)
    twice = p.unionByName(spark.createDataFrame([("2", "THEME", "t")], p.schema))
    for broken in ({"projects": twice}, {"links": spark.createDataFrame([("b", "a", 1.0, "t")], links.schema)}):
        with pytest.raises(store.SchemaError):
            s.commit(one, broken)
    assert s.open().revision == 1 and s.table("links").count() == 1
    (tmp_path / "db" / "MANIFEST.json").write_text(json.dumps({"schema_version": "9"}))
    with pytest.raises(store.SchemaError):
        store.Store(spark, str(tmp_path / "db"))


class Logged(notes.HashingEmbedder):
    """Writes down what it embeds, and dies on a text that says so while a file is there."""

    def __init__(self, folder, name="other"):
        super().__init__(4, name)
        self.folder = str(folder)

    def embed(self, texts, kind):
        import os
        import uuid

        if "die" in texts and os.path.exists(f"{self.folder}/die"):
            raise RuntimeError("killed")
        with open(f"{self.folder}/log-{uuid.uuid4().hex}", "w") as f:
            f.writelines(t + "\n" for t in texts)
        return super().embed(texts, kind)

    def log(self):
        from pathlib import Path

        return sorted(t for p in Path(self.folder).glob("log-*") for t in p.read_text().split("\n") if t)


def test_reembedding_goes_on_after_it_died(spark, tmp_path):
    embedder, folder = Logged(tmp_path), str(tmp_path / "shadow")
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(40)], "id string, text string")
    step = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("step"))
    last = step.filter("step = 3").first()["id"]
    dying = rows.withColumn("text", F.when(F.col("id") == last, "die").otherwise(F.col("text")))
    (tmp_path / "die").write_text("")
    with pytest.raises(Exception, match="killed"):
        notes.reembed(dying, folder, embedder, 4)
    kept = {r["id"] for r in notes.shadow_of(spark, folder, rows).collect()}
    assert kept == {r["id"] for r in step.filter("step < 3").collect()}
    (tmp_path / "die").unlink()
    for p in tmp_path.glob("log-*"):
        p.unlink()
    changed = dying.filter("id <> '0'").unionByName(spark.createDataFrame([("new", "text new")], rows.schema))
    got = {r["id"]: r["embedding"] for r in notes.reembed(changed, folder, embedder, 4).collect()}
    assert got.keys() == {r["id"] for r in changed.collect()} and all(len(v) == 4 for v in got.values())
    assert embedder.log() == sorted(r["text"] for r in changed.collect() if r["id"] not in kept)
    assert notes.reembed(rows.limit(0), str(tmp_path / "none"), embedder, 4).count() == 0


def test_another_model_is_published_as_a_whole(spark, tmp_path):
    s, embedder = store.Store(spark, str(tmp_path / "db")), Logged(tmp_path)
    note = lambda i, t: {"id": i, "site": "s", "conversation_id": i, "compacted_text": t}
    old = spark.createDataFrame([("a", [1.0, 0.0])], TABLES["note_vec"])
    at = s.commit(s.open(), {"notes": spark.createDataFrame([note("a", "one"), note("b", "two")], TABLES["notes"]), "note_vec": old}, {"embedder_id": "old", "embedder_dim": "2"})
    with pytest.raises(store.Conflict):
        notes.switch_model(s, str(tmp_path / "shadow"), embedder, "now", lambda: False, 2)
    assert s.open().meta["embedder_id"] == "old" and s.table("note_vec").collect() == old.collect()
    calls = []

    def late():  # a note comes between the embedding and its commit
        calls.append(1)
        return True

    class Racing(store.Store):
        def commit(self, at, tables, meta=None, fence=None, check=True):
            if not calls:
                late()
                super().commit(self.open(), {"notes": self.table("notes").unionByName(spark.createDataFrame([note("c", "three")], TABLES["notes"]))})
            return super().commit(at, tables, meta, fence, check)

    done = notes.switch_model(Racing(spark, str(tmp_path / "db")), str(tmp_path / "shadow"), embedder, "now", late, 2)
    assert done.meta == {"embedder_id": "other", "embedder_dim": "4"} and done.revision == at.revision + 2
    assert {r["id"]: len(r["embedding"]) for r in s.table("note_vec").collect()} == {"a": 4, "b": 4, "c": 4} and embedder.log() == ["one", "three", "two"]
    assert [(r["kind"], r["status"]) for r in s.table("jobs").collect()] == [("link-cluster", "queued")]
    assert notes.switch_model(s, str(tmp_path / "shadow"), embedder, "now").revision == done.revision
