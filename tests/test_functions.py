from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.functions import chunks, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_content_hash_ignores_case_and_all_white_space(spark):
    want = hashlib.sha256("keep ledgers in örebro".encode()).hexdigest()
    for t in ("keep ledgers in örebro", "\n\nKeep\u2009ledgers \t in\u2028ÖREBRO", "KEEP LEDGERS\x0b\x0cin Örebro\u1680\r"):
        assert one(spark, text.content_hash(F.lit(t))) == want
    assert one(spark, text.content_hash(F.lit(" \n"))) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("given_, want", [(None, None), ("", None), (" \t", None), ("\nGrain/Mill-2\t", "grain/mill-2"), ("SILO//", "silo//")])
def test_normalize_repo(spark, given_, want):
    assert one(spark, text.normalize_repo(F.lit(given_).cast("string"))) == want


@pytest.mark.parametrize("given_, want", [("/work/MyRepo", "myrepo"), ("MYREPO", "myrepo"), ("C:\\x\\Repo\\", "repo"), (" a/b// ", "b")])
def test_repo_leaf(spark, given_, want):
    assert one(spark, text.repo_leaf(F.lit(given_))) == want


@pytest.mark.parametrize(
    "name, repo, want",
    [
        ("Nightly exports", "lab/silo_7", "silo_7: Nightly exports"), ("granary: Nightly exports", "lab/silo_7", "silo_7: Nightly exports"), ("silo_7", "lab/silo_7", "silo_7"), ("lab/silo_7", "lab/silo_7", "silo_7"),
        ("\t\n", "lab/silo_7", "silo_7"), ("  as it was ", None, "  as it was "), ("F# parsers", "//Lab/F#//", "f#: F# parsers"), ("one: two: three", "q", "q: two: three"),
    ],
)
def test_repo_prefix(spark, name, repo, want):
    assert one(spark, text.enforce_repo_prefix(F.lit(name), F.lit(repo).cast("string"))) == want


@pytest.mark.parametrize("value, want", [("twelve", 20), ([7], 20), (False, 20), (-3.5, 20), (float("-inf"), 20), (float("nan"), 20), (0.25, 0), (7.75, 7), (49.5, 49), (1_000_000, 50), (13, 13)])
def test_limits(value, want):
    assert text.clamp_limit(value) == want


def test_scrub(spark):
    t = f"Use sk-{'a' * 26} with password: x"
    assert one(spark, text.scrub(F.lit(t))) == "Use [REDACTED] with password: [REDACTED]"


@pytest.mark.parametrize("x, want", [(0.12345, 0.1235), (-0.00005, 0.0), (0.5, 0.5)])
def test_round4(spark, x, want):
    assert one(spark, text.round4(F.lit(x))) == want


@pytest.mark.parametrize("a, b, want", [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([3, 4], [5, 0], 0.6), ([0, 0], [3, 4], 0), ([], [], 0), ([2, 1, 2, 4], [1, 0, 0, 0], 0.4)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"] == want


def test_cosine_of_different_lengths_fails(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("v, want", [([1.0, 2.0], True), ([1.0], False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False), ([None, 1.0], False), (None, False)])
def test_valid_vectors(spark, v, want):
    assert spark.createDataFrame([(v,)], "v array<float>").select(vectors.is_valid(F.col("v"), 2).alias("x")).first()["x"] is want


def test_parse_note_takes_strings_only(spark):
    note = one(spark, text.parse_note(F.lit('{"context": {"deep": 1}, "summary": "\\tshort ", "tags": ["  left", 8.5, "right", true, "\\t", {"k": "v"}, null], "open_threads": 3, "extra": []}')))
    assert (note["topic"], note["summary"], note["context"], note["tags"], note["open_threads"]) == ("", "short", "", ["left", "right"], [])
    for bad in ("", "{", "null", "[]", "1", "```json\n{}\n```"):
        assert one(spark, text.parse_note(F.lit(bad))) is None


def test_merge_notes(spark):
    made = [text.parse_note(F.lit(j)) for j in ('{"summary": " first ", "context": "why", "tags": ["a", " a "]}', '{"topic": "t", "summary": "second", "context": "later", "tags": ["b", "a", "B"]}')]
    note = one(spark, text.merge_notes(F.array(*made)))
    assert (note["topic"], note["summary"], note["context"], note["tags"]) == ("t", "first; second", "why", ["a", "b", "B"])


def test_render_and_parse_sections(spark):
    note = text.parse_note(F.lit('{"topic": "T", "summary": "S", "context": "C", "key_details": ["k1", "k2"], "decisions": ["d"], "open_threads": ["o"], "tags": ["x"]}'))
    rendered = one(spark, text.render_note(note))
    assert rendered == "**Topic**: T\n\n**One-line summary**: S\n\n**Context**: C\n\n**Key Details**:\n- k1\n- k2\n\n**Decisions & Reasoning**:\n- d\n\n**Open Threads**:\n- o"
    assert chunks.parse_sections(rendered) == ("C", [("key_details", ["k1", "k2"]), ("decisions", ["d"]), ("open_threads", ["o"])])
    assert chunks.parse_sections("plain\n*Unknown*: x\r\n• y\n– z") == (None, [("key_details", ["plain", "x", "y", "z"])])
    assert chunks.parse_sections("") == (None, [])
    df = spark.createDataFrame([(1, rendered), (2, None)], "id long, text string")
    found = {r["id"]: r for r in chunks.sections(df).collect()}
    assert found[1]["why"] == "C" and found[1]["sections"][1]["bullets"] == ["d"] and found[2]["sections"] == []


def test_chunks():
    assert chunks.chunk_text("one two\n3\n\nfour\n5", 9) == ["one two\n", "3\n\nfour\n5"]
    assert chunks.chunk_text("x" * 11 + "\ny", 5) == ["xxxxx", "xxxxx", "x\ny"]
    assert chunks.chunk_text("", 1) == [""]
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            chunks.chunk_text("x", bad)


@given(st.text(alphabet="ab\r\n😀é", max_size=60), st.sampled_from([1, 2, 3, 7, 100_000]))
def test_chunks_join_to_the_text(t, budget):
    parts = chunks.chunk_text(t, budget)
    assert "".join(parts) == t
    assert all(chunks.width(p) <= max(budget, 2) for p in parts)
