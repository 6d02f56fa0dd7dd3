from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionlake.functions.text import safe_excerpt
from sessionlake.operators import backfill, link_cluster, notes
from sessionlake.schemas import TABLES
from sessionlake.sources import calibration, repos, transcripts
from tests.test_sources import record, write


def notes_of(spark, rows):
    full = [(i, "s", i, None, 1, topic, None, "", [], repo, project, "m", "1", "1", "n") for i, repo, topic, project in rows]
    return spark.createDataFrame(full, TABLES["notes"])


def vec(spark, **named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], TABLES["note_vec"])


ROWS = [("a", " Org/App", "t1", None), ("b", "org/app ", "t2", None), ("c", "storage", "t3", None), ("d", "storage", "t4", None), ("e", None, "t5", None)]


def test_link_cluster(spark):
    notes, none = notes_of(spark, ROWS), spark.createDataFrame([], TABLES["projects"])
    v = vec(spark, a=[1, 0, 0], b=[1, 0, 0], c=[0, 1, 0], d=[0, 1, 0], e=[0, 0, 1])
    out = link_cluster.run(notes, v, none, 0.7, "now")
    assert sorted((r["a"], r["b"], r["similarity"]) for r in out.links.collect()) == [("a", "b", 1.0), ("c", "d", 1.0)]
    names = {r["id"]: r["name"] for r in out.projects.collect()}
    assert sorted(names.values()) == ["app: Sessions", "storage: Sessions"]
    by_note = {r["id"]: r["project_id"] and names[r["project_id"]] for r in out.notes.collect()}
    assert by_note == {"a": "app: Sessions", "b": "app: Sessions", "c": "storage: Sessions", "d": "storage: Sessions", "e": None}
    again = link_cluster.run(spark.createDataFrame(out.notes.collect(), TABLES["notes"]), v, spark.createDataFrame(out.projects.collect(), TABLES["projects"]), 0.7, "later")
    assert again.unchanged
    moved = vec(spark, a=[1, 0, 0], b=[-1, 0, 0], c=[0, 1, 0], d=[0, 1, 0], e=[0, 0, 1])
    assert sorted((r["a"], r["b"], r["similarity"]) for r in link_cluster.run(notes, moved, none, 0.7, "now").links.collect()) == [("a", "b", 0.5), ("c", "d", 1.0)]
    with pytest.raises(Exception, match="no vector for e"):
        link_cluster.run(notes, v.filter("id <> 'e'"), none, 0.7, "now")


def test_chat_is_asked_with_every_topic_and_the_repository(spark):
    rows = [(f"n{i:02}", "org/app" if i < 11 else "org/app " if i < 22 else None, f"topic {i % 4}" if i % 7 else " ", None) for i in range(33)]
    v = vec(spark, **{f"n{i:02}": [[1, 0, 0], [0, 1, 0], [0, 0, 1]][i // 11] for i in range(33)})
    asked = []
    out = link_cluster.run(notes_of(spark, rows), v, spark.createDataFrame([], TABLES["projects"]), 0.99, "now", lambda q: asked.append(json.loads(q)) or json.dumps([f"wrong: name {i}" for i in range(len(asked[-1]))]))
    [clusters] = asked
    assert [len(c["topics"]) for c in clusters] == [11, 11, 11]
    assert sorted((c["repository"] or "", c["clusters of the repository"]) for c in clusters) == [("", None), ("org/app", 2), ("org/app", 2)]
    assert sorted(t for c in clusters for t in c["topics"]) == sorted(r[2] if r[2].strip() else "untitled" for r in rows) and len(out.projects.collect()) == 3


def test_names_by_chat():
    assert link_cluster.asked_names(lambda q: json.dumps([f"n{i}" for i in range(len(json.loads(q)))]), [["x"], ["y"]]) == ["n0", "n1"]
    answers = iter(['["only one"]', '["one", "two"]'])
    assert link_cluster.asked_names(lambda q: next(answers), [["x"], ["y"]]) == ["one", "two"]
    for bad in ("no json", '["a", ""]', '{"a": 1}', '["one"]'):
        assert link_cluster.asked_names(lambda q, bad=bad: bad, [["x"], ["y"]]) is None
    assert link_cluster.asked_names(None, [["x"]]) is None


def test_import(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", record("user", "s", "q"), "{bad", record("assistant", "s", "r", "u1"))
    captures, errors = backfill.imported(transcripts.records(transcripts.read_lines(spark, path)), "site", "now")
    assert [(r["conversation_id"], r["source_key"], r["prompt"], r["response"], r["captured_at"]) for r in captures.collect()] == [("s", "u1", "q", "r", "t")] and errors.first()["errors"] == 1


def test_imported_captures_can_be_distilled(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", record("user", "s", "q", cwd="/work/tools"), record("assistant", "s", "r", "u1"), record("user", "o", "q2"), record("assistant", "o", "r2", "u2"))
    known = spark.createDataFrame([("/work/tools", "tools"), ("/work/tools", "tools")], "cwd string, repo string")
    captures, _ = backfill.imported(transcripts.records(transcripts.read_lines(spark, path)), "site", "now", known)
    assert {r["conversation_id"]: r["metadata"] for r in captures.collect()} == {"s": '{"repo_name":"tools"}', "o": "{}"}
    made, _ = notes.distilled(captures, lambda chunk: F.lit('{"topic": "t", "decisions": ["keep it"]}'), "now", "model")
    assert {(r["conversation_id"], r["repo_name"], r["topic"], r["turn_count"]) for r in made.collect()} == {("s", "tools", "t", 1), ("o", None, "t", 1)}


def test_repositories(spark, tmp_path):
    (tmp_path / "Repo" / ".git").mkdir(parents=True)
    (tmp_path / "Repo" / "sub" / "tree").mkdir(parents=True)
    (tmp_path / "Repo" / "sub" / ".git").write_text("gitdir: elsewhere")
    (tmp_path / "Repo" / ".git" / "HEAD").write_text("ref")
    (tmp_path / "Repo" / "sub" / "In ner" / ".git").mkdir(parents=True)
    (tmp_path / "Repo" / "sub" / "In ner" / ".git" / "HEAD").write_text("ref")
    folders = repos.git_folders(spark, str(tmp_path))
    assert {r["path"] for r in folders.collect()} == {str(tmp_path / "Repo"), str(tmp_path / "Repo" / "sub" / "In ner")}
    base = str(tmp_path)
    asked = [f"{base}/Repo", f"{base}/Repo/sub/tree", f"{base}//Repo/./sub/tree/", f"{base}/Repo/sub/In ner/x", f"{base}/Repo/sub/In ner/../x", f"{base}/Repository", base, "/", "/..", "", "Repo", None]
    df = spark.createDataFrame([(i, c, "old") for i, c in enumerate(asked)], "i int, cwd string, repo string")
    want = ["repo", "repo", "repo", "in ner", "repo", *[None] * 7]
    got = {r["i"]: r["repo"] for r in repos.with_repo(df, folders).collect()}
    assert [got[i] for i in range(len(asked))] == want
    root = spark.createDataFrame([("/",), (None,), ("a",)], "path string")
    assert {r["repo"] for r in repos.with_repo(df, root).collect()} == {None} == {r["repo"] for r in repos.with_repo(df, folders.limit(0)).collect()}


def test_a_page_keeps_its_files_apart(spark, tmp_path):
    good = write(tmp_path / "a b.jsonl", record("user", "s", "q"), record("assistant", "s", "r", "u1"), record("assistant", "s", "r2", "u2"))
    half = write(tmp_path / "half.jsonl", record("user", "s", "other"), "{bad", record("assistant", "s", "r", "u1"), record("assistant", "t", "nobody"), record("user", "t", "q3"), record("assistant", "t", "r3", "u3"))
    torn, gone, empty = write(tmp_path / "torn.jsonl", record("user", "x", "q"), record("assistant", "x", "r", "u9")), str(tmp_path / "gone.jsonl"), tmp_path / "empty.jsonl"
    (tmp_path / ".torn.jsonl.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")  # a checksum that is not the file's
    empty.write_bytes(b"")
    paths = [good, half, torn, gone, str(empty)]
    stored = spark.createDataFrame([], TABLES["captures"])
    new, results = backfill.import_page(spark, 3, paths, stored, "cli", "now")
    assert {(r["conversation_id"], r["source_key"], r["prompt"]) for r in new.collect()} == {("s", "u1", "q"), ("s", "u2", "q"), ("t", "u3", "q3")}
    row = results.first()
    assert (row["page"], row["inserted"], row["conversations"], results.count()) == (3, 3, ["s", "t"], 1)
    failures = {f["path"]: (f["error"], f["parse_errors"]) for f in row["failures"]}
    assert failures.keys() == {half, torn, gone} and failures[half] == ("1 malformed records", 1) and failures[gone] == ("no such file", None) and failures[torn][0].startswith("could be read up to byte 0 of")
    again, results = backfill.import_page(spark, 3, paths, new, "cli", "now")
    assert again.count() == 0 and (results.first()["inserted"], results.first()["conversations"], len(results.first()["failures"])) == (0, [], 3)
    whole = backfill.rolled_up(results).first()
    assert (whole["inserted"], whole["outcome"], len(whole["failures"])) == (0, "partial", 3)
    _, results = backfill.import_page(spark, 0, [gone], stored, "cli", "now")
    assert [f["error"] for f in results.first()["failures"]] == ["no such file"]


def test_calibration_corpus(spark, tmp_path):
    good = [json.dumps({"id": str(i), "text": "t"}) for i in range(5)]
    assert calibration.read_corpus(spark, write(tmp_path / "a.jsonl", *good), 5).count() == 5
    for bad in (json.dumps({"id": "0", "text": "twice"}), json.dumps({"id": "9", "text": " "}), json.dumps({"id": 9, "text": "x"}), "{"):
        with pytest.raises(calibration.CorpusError):
            calibration.read_corpus(spark, write(tmp_path / "b.jsonl", *good, bad), 5)
    with pytest.raises(calibration.CorpusError):
        calibration.read_corpus(spark, str(tmp_path / "a.jsonl"), 6)
    assert len(calibration.digest(spark, str(tmp_path / "a.jsonl"))) == 64


def test_excerpts_hold_no_secrets(spark):
    t = 'Authorization: Basic abc\nkey s"x and s\\"x, bearer tok.en\nend'
    made = lambda t, secrets: spark.range(1).select(safe_excerpt(F.lit(t), secrets)).first()[0]
    out = made(t, ['s"x'])
    assert "abc" not in out and "tok.en" not in out and 's"x' not in out and 's\\"x' not in out and "\n" not in out
    assert out.endswith(" end") and len(made("y" * 999, [])) == 512
