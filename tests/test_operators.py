from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlake.functions.text import tool_limit
from sessionlake.operators.order import row_numbers
from sessionlake.operators import backfill, calibrate, captures, decisions, graph, jobs, notes, search


def vecs(spark, **named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "id string, v array<double>")


def edges_of(df):
    return sorted((r["a"], r["b"], round(r[2], 6)) for r in df.collect())


def at(s, dim=4):
    return [s, math.sqrt(1 - s * s)] + [0.0] * (dim - 2)


# --- links


def test_links_threshold_is_inclusive(spark):
    v = vecs(spark, z=[3, 4], a=[1, 0], b=[-1, 0])
    assert edges_of(graph.links(v, 0.6)) == [("a", "z", 0.6)]
    assert edges_of(graph.links(v, 0.60001)) == []


def test_links_ties_by_id_and_degree_beyond_k(spark):
    same = vecs(spark, d=[1, 0], b=[1, 0], c=[1, 0], a=[1, 0])
    assert [e[:2] for e in edges_of(graph.links(same, 1.0, 1))] == [("a", "b"), ("a", "c"), ("a", "d")]
    assert edges_of(graph.links(same, 1.0, 0)) == []
    twelve = vecs(spark, **{f"n{i:02}": [1, 0] for i in range(12)})
    assert len(edges_of(graph.links(twelve, 0.7))) == 65
    odd = spark.createDataFrame([(k, [1.0, 0.0]) for k in ("a", "a|b", "b|c", "c")], "id string, v array<double>")
    assert len(edges_of(graph.links(odd, 0.7))) == 6
    with pytest.raises(ValueError):
        graph.links(same, 1.0, -1)


def test_links_in_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_PART", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(r["src"], r["dst"]) for r in graph.neighbours(v, 0.3, 4).collect()}
    sim = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = set()
    for i in range(60):
        order = sorted((j for j in range(60) if j != i and sim[i, j] >= 0.3), key=lambda j: (-sim[i, j], j))
        want |= {(i, j) for j in order[:4]}
    assert got == want


def test_a_tile_holds_no_more_than_the_best(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    folds = []
    monkeypatch.setattr(graph, "BLOCK", 64)
    monkeypatch.setattr(graph, "tiled", lambda left, right, fold, schema: folds.append(fold) or spark.createDataFrame([], schema))
    graph.neighbours(spark.createDataFrame([], "id long, v array<double>"), None, 10)
    v = np.random.default_rng(8).normal(size=(4000, 8))
    ids = pa.array(np.arange(4000)[::-1])
    tracemalloc.start()
    (found,) = folds[0](ids, v, ids, None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # with ten from every block, it would be over 100 MB
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {(3999 - i, 3999 - j) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10].tolist()) for j in row}
    assert {*zip(found["src"].to_pylist(), found["dst"].to_pylist(), strict=True)} == want


def test_backbone(spark):
    rows = [("b", [1.0, 0.0], " APP "), ("a", [-1.0, 0.0], "app"), ("l", [1.0, 0.0], "lone"), ("n", [1.0, 0.0], None), ("e", [1.0, 0.0], " ")]
    n = spark.createDataFrame(rows, "id string, v array<double>, repo string")
    assert edges_of(graph.backbone(n)) == [("a", "b", 0.5)]
    four = spark.createDataFrame([("a", [1.0, 0.0], "r"), ("b", [1.0, 0.0], "r"), ("c", [-1.0, 0.0], "r"), ("d", [-1.0, 0.0], "r")], n.schema)
    assert [e[:2] for e in edges_of(graph.backbone(four, 1))] == [("a", "b"), ("c", "d")]
    assert len(edges_of(graph.backbone(four))) == 6


def test_threshold_link_wins_over_backbone(spark):
    t = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, similarity double")
    b = spark.createDataFrame([("a", "b", 0.5), ("c", "d", 0.5)], t.schema)
    assert edges_of(graph.merged(t, b)) == [("a", "b", 1.0), ("c", "d", 0.5)]


# --- clusters


def partition(spark, ids, edges):
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    weights = spark.createDataFrame(edges, "a string, b string, weight double")
    out = {}
    for r in graph.numbered(graph.clusters(nodes, weights)).collect():
        out.setdefault(r["cluster"], []).append(r["id"])
    return ["".join(sorted(out[k])) for k in sorted(out)]


def clique(ids, w):
    return [(a, b, w) for i, a in enumerate(ids) for b in ids[i + 1 :]]


def test_clusters(spark):
    assert partition(spark, "cab", []) == ["a", "b", "c"]
    ids, e = list("abcdefghs"), clique("abcd", 1.0) + clique("efgh", 1.0) + [("d", "e", 0.01)]
    assert partition(spark, ids, e) == ["abcd", "efgh", "s"]
    random.Random(1).shuffle(ids)
    assert partition(spark, ids, [(b, a, w) for a, b, w in reversed(e)] + [("a", "zz", 1.0), ("a", "b", 1.0)]) == ["abcd", "efgh", "s"]


@pytest.mark.parametrize("repo, want", [("r", ["abcd"]), (" ", ["ab", "cd"]), (None, ["ab", "cd"])])
def test_boost_within_a_repository(spark, repo, want):
    ids = "abcduvwxyz"
    e = [("a", "b", 0.2), ("b", "c", 0.06), ("c", "d", 0.2)] + clique("uvwxyz", 0.2)
    n = spark.createDataFrame([(i, repo if i in "abcd" else None) for i in ids], "id string, repo string")
    weights = graph.boosted(spark.createDataFrame(e, "a string, b string, similarity double"), n)
    assert sorted(p for p in partition(spark, ids, [tuple(r) for r in weights.collect()]) if p[0] in "abcd") == want


def test_reconcile(spark):
    def run(components, projects):
        c = spark.createDataFrame([(k, m) for k, ms in components.items() for m in ms], "component string, id string")
        p = spark.createDataFrame([(k, m) for k, ms in projects.items() for m in ms], "project string, id string")
        found = graph.reconcile(c, p)
        return {r["component"]: r["project"] for r in found.collect()}, {r["project"] for r in graph.deleted_projects(p, found).collect()}

    assert run({"1": ["a", "b", "new"], "2": ["c", "d"], "3": ["old"]}, {"keep": ["a", "b", "old"], "gone": ["x", "y"]}) == ({"1": "keep", "2": None}, {"gone"})
    assert run({"1": list("abc"), "2": list("de")}, {"p": list("abcde")}) == ({"1": "p", "2": None}, set())
    assert run({"1": list("ab"), "2": list("cd")}, {"p": list("abcd")}) == ({"1": None, "2": None}, {"p"})


def test_unchanged(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "s")], "component long, id string")
    p = spark.createDataFrame([("x", "b"), ("x", "a")], "project string, id string")
    named = spark.createDataFrame([("x",)], "project string")
    assert graph.is_unchanged(c, p, named)
    assert not graph.is_unchanged(c, p, spark.createDataFrame([("x",), ("empty",)], "project string"))


def test_names(spark):
    assert graph.unique_names(["Theme"], ["theme", "THEME"]) == ["theme (2)", "THEME (3)"]
    with pytest.raises(ValueError):
        graph.unique_names(["a", "a (2)"], ["A"], attempts=2)
    rows = spark.createDataFrame([(0, "Org/App", "x"), (1, None, "Storage"), (2, None, None)], "i int, repo string, topic string")
    assert [r["n"] for r in rows.select(graph.fallback_name(F.col("i"), F.col("repo"), F.col("topic")).alias("n")).collect()] == ["app: Sessions", "Storage", "Project 3"]
    votes = spark.createDataFrame([("x", "B"), ("x", "b"), ("x", "a"), ("x", None), ("y", "b"), ("y", "A"), ("z", " ")], "cluster string, repo string")
    assert {r["cluster"]: r["repo"] for r in graph.dominant_repo(votes).collect()} == {"x": "b", "y": "a", "z": None}


# --- search


def embeddings(spark, **named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "id string, embedding array<float>")


def found(df):
    return [(r["kind"], r["id"], round(r["similarity"], 6), r["via"]) for r in df.collect()]


def test_search_ranks_and_expands(spark):
    note_vec = embeddings(spark, A=[8, 0, 0, 0], edge=[2, 1, 2, 4], low=at(0.3999))
    decision_vec = embeddings(spark, D=at(0.8), edge=[2, 1, 2, 4])
    n = spark.createDataFrame([("A",), ("edge",), ("low",), ("novec",)], "id string")
    d = spark.createDataFrame([("D",), ("edge",)], "id string")
    none = spark.createDataFrame([], "a string, b string, similarity double")
    assert found(search.search(n, note_vec, d, decision_vec, none, [1, 0, 0, 0])) == [("note", "A", 1.0, "anchor"), ("decision", "D", 0.8, "anchor"), ("note", "edge", 0.4, "anchor"), ("decision", "edge", 0.4, "anchor")]

    note_vec = embeddings(spark, M=[1, 0, 0, 0], Z=at(0.95), B=[-1, 0, 0, 0], T=[-1, 0, 0, 0])
    n = spark.createDataFrame([(x,) for x in "MZBCT"], "id string")
    e = spark.createDataFrame([("B", "M", 0.6), ("B", "Z", 0.8), ("C", "M", 0.7), ("B", "T", 1.0), ("M", "Z", 0.99)], none.schema)
    assert found(search.search(n, note_vec, d.limit(0), decision_vec.limit(0), e, [1, 0, 0, 0])) == [("note", "M", 1.0, "anchor"), ("note", "Z", 0.95, "anchor"), ("note", "B", 0.8, "link"), ("note", "C", 0.7, "link")]


def test_search_caps_neighbours_by_their_best_edge(spark):
    n = spark.createDataFrame([("M",), ("Z",)] + [(f"n{i:03}",) for i in range(426)], "id string")
    v = embeddings(spark, M=[1, 0, 0, 0], Z=[1, 0, 0, 0])
    e = spark.createDataFrame([("M", f"n{i:03}", 0.5) for i in range(426)] + [("Z", "n425", 0.9)], "a string, b string, similarity double")
    near = graph.best_edges(e, search.scored(v, [1, 0, 0, 0], 0.4))
    assert near.count() == 426
    top = found(search.search(n, v, n.limit(0), v.limit(0), e, [1, 0, 0, 0], 50))
    assert top[2] == ("note", "n425", 0.9, "link") and top[3][1] == "n000" and len(top) == 50


def test_failures_give_no_rows(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("late")).alias("x"))
    out = search.fail_closed(lambda: bad)
    assert out.rows == [] and "late" in out.error
    assert search.fail_closed(lambda: spark.range(1)).error is None


# --- decisions

RAIL = decisions.Rail(0.70, 0.70, 0.60, 0.55)


def test_check_and_standing(spark):
    named = {f"d{i:02}": at(0.6 + i / 200) for i in range(45)} | {"one": at(1.0), "ledger": at(0.99), "low": at(0.54)}
    d = spark.createDataFrame([(k,) for k in named], "id string")
    got = [r["id"] for r in decisions.check(d, embeddings(spark, **named), [1, 0, 0, 0], 0.55).collect()]
    assert len(got) == 40 and got[:2] == ["one", "ledger"] and "low" not in got
    dated = spark.createDataFrame([("a", "2025"), ("b", "2026"), ("c", "2024"), ("d", None), ("e", "2026")], "id string, decided_at string")
    assert [r["id"] for r in decisions.standing(dated).collect()] == ["b", "e", "a", "c", "d"]
    topic = embeddings(spark, a=at(0.9), b=at(0.8), c=at(0.7), d=at(0.6), e=at(0.85))
    assert [r["id"] for r in decisions.standing_on_topic(dated, topic, [1, 0, 0, 0], 0.55, cap=4).collect()] == ["e", "b", "a", "c"]


def test_nan_is_not_similar(spark):
    v = spark.createDataFrame([("a", [float("nan"), 1.0])], "id string, embedding array<float>")
    assert search.scored(v, [1.0, 0.0], 0.1).count() == 0


def test_dedup_ladder(spark):
    at_ = lambda x: [x, math.sqrt(1 - x * x)]
    new = spark.createDataFrame([("n1", "Use  SQLITE", [1.0, 0.0]), ("n2", "other", [1.0, 0.0]), ("n3", "third", at_(-0.2)), ("n4", "none", [-1.0, 0.0]), ("n5", "alone", None)], "id string, text string, embedding array<double>")
    old = spark.createDataFrame(
        [("o1", "use sqlite", "2", at_(0.1)), ("o2", "x", "1", at_(0.8)), ("o3", "y", "1", at_(0.8)), ("o4", "z", "0", at_(0.75)), ("o5", "use SQLite", "0", None), ("o6", "w", "0", at_(0.65))], "id string, text string, created_at string, embedding array<double>"
    )

    def run(rail, judge=None):
        return {r["incoming"]: (r["candidate"], r["band"], r["also"]) for r in decisions.dedup_candidates(new, old, rail, judge).collect()}

    assert run(RAIL) == {"n1": ("o1", "exact", ["o5"]), "n2": ("o2", "merge", ["o3", "o4"]), "n3": ("o1", "merge", [])}
    yes = lambda a, b: F.lit(True)
    assert run(RAIL, yes)["n2"] == ("o2", "merge", ["o3", "o4", "o6"])
    guarded = run(RAIL.guarded(), yes)
    assert guarded["n2"] == ("o2", "judge", ["o3", "o4", "o6"]) and "n4" not in guarded and "n5" not in guarded and run(RAIL.guarded()).keys() == {"n1"}


@pytest.mark.parametrize("floor", [-2.0, 0.3, 0.8])
def test_similar_finds_every_pair(spark, monkeypatch, floor):
    monkeypatch.setattr(graph, "LEAST_PART", 5)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((40, 6)) + 3 * c for c in np.eye(6)[:3]] + [np.zeros((2, 6))])
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<float>")
    x = x.astype(np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    sim = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((len(x), len(x))), where=np.outer(norm, norm) > 0)
    own = sorted(tuple(sorted((r["src"], r["dst"]))) for r in graph.similar(v, None, floor).collect())
    assert own == [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sim[i, j] >= floor]
    both = sorted((r["src"], r["dst"]) for r in graph.similar(v.filter("id % 3 = 0"), v.filter("id % 2 = 0"), floor).collect())
    assert both == [(i, j) for i in range(0, len(x), 3) for j in range(0, len(x), 2) if sim[i, j] >= floor]
    assert graph.similar(v.limit(0), v, floor).count() == graph.similar(v, v.limit(0), floor).count() == graph.similar(v.limit(0), None, floor).count() == 0


def test_vectors_are_sent_to_few_tiles(spark, monkeypatch):
    """With T tiles a table is sent about sqrt(2 T) times, not T times."""
    monkeypatch.setattr(graph, "LEAST_PART", 8)
    monkeypatch.setattr(graph, "TILE_BYTES", 8 * 8 * 2)
    v = spark.range(400).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit(0).alias("group"))

    def sizes(a_ids, a, b_ids, b):
        yield pa.RecordBatch.from_arrays([pa.array([len(a) + (len(b) if b is not None else 0)])], ["n"])

    rows = [r["n"] for r in graph.tiled(v, None, sizes, "n long").collect()]
    assert len(rows) == 50 * 51 // 2 and sum(rows) == 400 * 50 < 400 * math.sqrt(2 * len(rows)) + 400
    rect = [r["n"] for r in graph.tiled(v, v.filter("id < 100"), sizes, "n long").collect()]
    assert len(rect) == 50 * 13 and sum(rect) == 400 * 13 + 100 * 50


def test_rails_are_never_substituted(monkeypatch):
    assert decisions.rail_for("local-768").floor == 0.7491
    with pytest.raises(decisions.UnknownModel):
        decisions.rail_for("x")
    monkeypatch.setitem(decisions.DIMENSIONS, "new", 4)
    with pytest.raises(decisions.UnmeasuredModel):
        decisions.rail_for("new")


def test_reconcile_decisions(spark):
    old = spark.createDataFrame([("n", "kept", "distilled"), ("n", "gone", "distilled"), ("n", "human", "ratified"), ("m", "other", "distilled")], "note_id string, content_hash string, provenance string")
    new = spark.createDataFrame([("n", "kept"), ("n", "fresh")], "note_id string, content_hash string")
    assert {(r["content_hash"], r["action"]) for r in decisions.reconcile(old, new).collect()} == {("kept", "keep"), ("gone", "delete"), ("human", "keep"), ("fresh", "insert")}


STORED = "id string, decision_text string, reason string, topic string, content_hash string, provenance string, human_quote string, origin string, decided_at string, created_at string"
WANTED = "id string, text string, reason string, topic string, quote string, confirmed boolean, pick string"


def test_ratified(spark):
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stored = spark.createDataFrame(
        [("d", "use x", None, None, hashed("use x"), "distilled", None, "local", None, "2"), ("r", "use y", None, None, hashed("use y"), "ratified", "first", "local", None, "1"), ("l", "use z", None, None, hashed("use z"), "distilled", None, "ledger", None, "0")], STORED
    )
    wanted = spark.createDataFrame(
        [
            ("1", " USE  x", None, None, "a", True, "r"), ("2", "use x", None, None, "b", True, None), ("3", "use y", None, None, "c", True, None), ("4", "use z", "why", "t", "e", True, "gone"), ("5", "Use z", None, None, "f", True, None),
            ("6", "use w", None, None, "g", True, "r"), ("7", "use v", None, None, " ", True, None), ("8", "use v", None, None, "h", None, None), ("9", "use u", None, None, "i", True, "l"),
        ], WANTED,
    )
    found = decisions.ratified(stored, wanted, "now")
    after, outcomes = found.decisions, found.outcomes
    done = {r["id"]: (r["action"], r["decision_id"]) for r in outcomes.collect()}
    assert [done[str(i)][0] for i in range(1, 10)] == ["upgrade", "upgrade", "keep", "insert", "keep", "requote", "refuse", "refuse", "insert"]
    assert done["4"][1] == done["5"][1] and done["7"][1] is None and done["6"][1] == "r"
    rows = {r["id"]: r for r in after.collect()}
    assert len(rows) == 5 and (rows["d"]["provenance"], rows["d"]["human_quote"]) == ("ratified", "a") and rows["r"]["human_quote"] == "g" and rows["l"]["provenance"] == "distilled"
    made = rows[done["4"][1]]
    assert (made["decision_text"], made["reason"], made["provenance"], made["human_quote"], made["decided_at"]) == ("use z", "why", "ratified", "e", "now")
    none = decisions.ratified(stored.limit(0), wanted.limit(0), "now")
    assert none.decisions.count() == none.outcomes.count() == none.vectors.count() == 0


def test_ratify_stores_no_secret(spark):
    key = "sk-" + "a" * 24
    wanted = spark.createDataFrame([("1", f"use {key}", f"since password: {key}", key, f"yes {key}", True, [0.0, 1.0]), ("2", "use [REDACTED]", None, None, "again", True, [1.0, 0.0])], WANTED.replace("pick string", "embedding array<double>"))
    stored = spark.createDataFrame([], STORED)
    vectors = spark.createDataFrame([], "id string, embedding array<double>")
    found = decisions.ratify(stored, vectors, wanted, RAIL, "now")
    row = found.decisions.collect()
    assert len(row) == 1 and key not in str(row) and row[0]["content_hash"] == hashlib.sha256(b"use [redacted]").hexdigest()
    assert [(r["id"], r["embedding"]) for r in found.vectors.collect()] == [(row[0]["id"], [0.0, 1.0])]
    assert {r["id"]: r["action"] for r in found.outcomes.collect()} == {"1": "insert", "2": "keep"}


def test_the_most_similar_of_equal_texts_is_ratified(spark):
    hashed = hashlib.sha256(b"same").hexdigest()
    stored = spark.createDataFrame([(i, "same", None, None, hashed, "distilled", None, "local", None, at) for i, at in (("a", "1"), ("b", "2"), ("c", "0"))], STORED)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    wanted = spark.createDataFrame([("1", "Same", None, None, "yes", True, None, [0.1, 1.0]), ("2", "same ", None, None, "yes", True, None, None)], WANTED + ", embedding array<double>")
    done = {r["id"]: r["decision_id"] for r in decisions.ratified(stored, wanted, "now", vectors).outcomes.collect()}
    assert done == {"1": "b", "2": "c"}


def test_receipt_and_listing(spark):
    found = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "id string, similarity double")
    assert decisions.receipt(found, "s", "now", "1").first().asDict() == {"id": "1", "statement": "s", "surfaced_ids": ["c", "a", "b"], "surfaced_at": "now"}
    assert decisions.receipt(found.limit(0), "s", "now", "1").first()["surfaced_ids"] == []
    many = spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 3, F.format_string("%02d", "id")).alias("decided_at"))
    listed = [r["id"] for r in decisions.listing(many).collect()]
    assert len(listed) == 60 and listed[0] == "59" and listed[-4:] == ["0", "1", "2", "3"]


def test_search_fails_on_links_without_a_similarity(spark):
    note = spark.createDataFrame([("n",), ("m",), ("k",)], "id string")
    none = spark.createDataFrame([], "id string, embedding array<double>")
    v = embeddings(spark, n=at(0.9), m=at(0.1), k=at(0.2))
    found = lambda rows: search.fail_closed(lambda: search.search(note, v, none, none, spark.createDataFrame(rows, "a string, b string, similarity double"), [1, 0, 0, 0]))
    for bad in (float("nan"), float("inf"), float("-inf"), None):
        got = found([("m", "n", 0.7), ("k", "n", 0.5), ("m", "n", bad)])
        assert got.rows == [] and "a link without a similarity" in got.error, bad
        assert found([("m", "n", 0.7), ("k", "m", bad), ("x", "y", bad)]).error is None  # no anchor, so the link is not looked at
    broken = v.unionByName(spark.createDataFrame([("orphan", [float("nan")] * 4)], v.schema))
    assert len(search.fail_closed(lambda: search.search(note, broken, none, none, spark.createDataFrame([], "a string, b string, similarity double"), [1, 0, 0, 0])).rows) == 1
    known = note.unionByName(spark.createDataFrame([("orphan",)], "id string"))
    assert "a broken vector" in search.fail_closed(lambda: search.search(known, broken, none, none, spark.createDataFrame([], "a string, b string, similarity double"), [1, 0, 0, 0])).error


def test_search_fails_closed_and_has_texts(spark):
    note = spark.createDataFrame([("n", "t", "s", "x"), ("m", "u", None, "y")], "id string, topic string, summary string, compacted_text string")
    said = spark.createDataFrame([("d", "t", "why", "z", "2024", "ratified")], "id string, topic string, reason string, decision_text string, decided_at string, provenance string")
    v, w = embeddings(spark, n=at(0.9), m=at(0.1)), embeddings(spark, d=at(0.8))
    edges = spark.createDataFrame([("m", "n", 0.7)], "a string, b string, similarity double")
    query = [1, 0, 0, 0]
    found = search.hydrated(search.search(note, v, said, w, edges, query), note, said).collect()
    assert [(r["kind"], r["id"], r["text"], r["via"], r["provenance"]) for r in found] == [("note", "n", "x", "anchor", None), ("decision", "d", "z", "anchor", "ratified"), ("note", "m", "y", "link", None)]
    lost = search.fail_closed(lambda: search.search(note.filter("id = 'n'"), v, said, w, edges, query))
    assert lost.rows == [] and lost.error
    broken = v.withColumn("embedding", F.when(F.col("id") == "m", F.array(*[F.lit(float("nan")).cast("float")] * 4)).otherwise(F.col("embedding")))
    assert search.fail_closed(lambda: search.search(note, broken, said, w, edges, query)).error


def test_tokens_and_masks_must_agree(spark):
    rows = lambda *r: notes.truncated(spark.createDataFrame([*r], "id int, ids array<int>, mask array<int>"), 2)
    assert [tuple(r) for r in rows((1, [5, 6, 7], [1, 0, 1])).collect()] == [(1, [5, 6], [1, 0])]
    for bad in ((1, [], []), (1, [5], [1, 1]), (1, [5], [2]), (1, None, [1]), (1, [5], None)):
        with pytest.raises(Exception, match="do not agree"):
            rows(bad).collect()


@pytest.mark.parametrize("value, want", [(None, None), (1, 1), (50, 50), (7.0, 7)])
def test_tool_limits(value, want):
    assert tool_limit(value) == want


@pytest.mark.parametrize("value", [0, 51, -2, 1.5, "3", True, float("nan"), float("inf")])
def test_bad_tool_limits(value):
    with pytest.raises(ValueError):
        tool_limit(value)


# --- captures


def test_pairing_shares_users_and_skips_orphans(spark):
    rows = [("s1", 0, "user", "a", "/w"), ("s2", 1, "user", "b", None), ("s2", 2, "assistant", "B", None), ("s1", 3, "assistant", "A", None), ("s1", 4, "assistant", "A2", "/x"), ("s3", 5, "assistant", "orphan", None), ("s1", 6, "assistant", "", None), ("s4", 7, "user", "q", None), ("s4", 8, "system", "z", None)]
    got = captures.pair_turns(spark.createDataFrame(rows, "session string, position long, role string, text string, cwd string")).orderBy("position").collect()
    assert [(r["session"], r["prompt"], r["response"], r["cwd"]) for r in got] == [("s2", "b", "B", None), ("s1", "a", "A", "/w"), ("s1", "a", "A2", "/x")]


def test_majority_repo(spark):
    rows = [("c", 0, "Other"), ("c", 1, "/work/MyRepo"), ("c", 2, "MYREPO"), ("t", 0, "a"), ("t", 1, "b"), ("n", 0, None), ("n", 1, " ")]
    got = captures.majority_repo(spark.createDataFrame(rows, "conversation string, position long, repo string")).collect()
    assert {r["conversation"]: r["repo"] for r in got} == {"c": "myrepo", "t": "b", "n": None}
    meta = spark.createDataFrame([('{"repo_name": "x"}',), ('{"repo_name": 3}',), ("[",), ("[1]",), (None,)], "m string")
    assert [r["r"] for r in meta.select(captures.repo_of_metadata(F.col("m")).alias("r")).collect()] == ["x", None, None, None, None]


def test_late_captures_stay_pending(spark):
    c = spark.createDataFrame([("a", None), ("b", None), ("c", "old")], "id string, distilled_at string")
    done = captures.stamped(c, c.filter("id = 'a'"), "now")
    assert {r["id"]: r["distilled_at"] for r in done.collect()} == {"a": "now", "b": None, "c": "old"}
    assert captures.pending(done).count() == 1


# --- notes

ANSWER = '{"topic": "T", "summary": "S", "context": "", "key_details": ["k"], "decisions": ["Use  X", "use x", "Y"], "tags": ["t"]}'


def test_distil(spark):
    ddl = "site string, conversation_id string, conversation_title string, prompt string, response string, captured_at string, created_at string, seq long, metadata string"
    rows = [("s", "c", None, "p3", "r3", "3", "0", 2, '{"repo_name":"MYREPO"}'), ("s", "c", "title", "p1", "password: hunter2hunter2", "1", "0", 0, '{"repo_name":"Other"}'), ("s", "c", None, "p2", "r2", "2", "0", 1, '{"repo_name":"/work/MyRepo"}')]
    seen = []

    def chat(chunk):
        seen.append(chunk)
        return F.when(chunk.contains("[REDACTED]") & ~chunk.contains("hunter2"), F.lit(ANSWER))

    made, said = notes.distilled(spark.createDataFrame(rows, ddl), chat, "now", "m")
    n = made.first()
    assert (n["turn_count"], n["repo_name"], n["conversation_title"], n["first_captured_at"], n["last_captured_at"], n["topic"], n["entity_tags"]) == (3, "myrepo", "title", "1", "3", "T", ["t"])
    assert sorted(r["text"] for r in said.collect()) == ["Use  X", "Y"] and len(seen) == 1
    with pytest.raises(Exception, match="no JSON object"):
        notes.distilled(spark.createDataFrame(rows, ddl), lambda c: F.lit("no"), "now", "m")[0].collect()


def test_upsert_keeps_the_id_alone(spark):
    ddl = "id string, site string, conversation_id string, topic string, project_id string"
    old = spark.createDataFrame([("1", "s", "a", "old", "p"), ("2", "s", "b", "other", "p")], ddl)
    new = spark.createDataFrame([("x", "s", "a", "new", None), ("y", "s", "c", "fresh", None)], ddl)
    got = {r["conversation_id"]: (r["id"], r["topic"], r["project_id"]) for r in notes.upserted(old, new).collect()}
    assert got == {"a": ("1", "new", None), "b": ("2", "other", "p"), "c": ("y", "fresh", None)}


def test_reembedding_resumes(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, text string")
    shadow = spark.createDataFrame([("a", [9.0, 9.0, 9.0]), ("orphan", [1.0, 1.0, 1.0])], "id string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in notes.reembedded(rows, shadow, notes.HashingEmbedder(3)).collect()}
    assert got.keys() == {"a", "b", "c"} and got["a"] == [9.0, 9.0, 9.0] and len(got["b"]) == 3
    with pytest.raises(Exception, match="no vector for b"):
        notes.require_vectors(rows, shadow).collect()

    class Wrong(notes.HashingEmbedder):
        def embed(self, texts, kind):
            return super().embed(texts, kind)[:, :-1]

    with pytest.raises(Exception, match="not of 3 finite numbers"):
        notes.embedded(rows, Wrong(3)).collect()


def test_pooling():
    t = np.array([[[3.0, 4.0], [np.nan, 1.0]]])
    assert notes.pool(t, np.array([[1, 0]])).tolist() == [[np.float32(0.6), np.float32(0.8)]]
    assert notes.pool(t, np.array([[1, 0]]), "cls", normalize=False).tolist() == [[3.0, 4.0]]
    for bad in (np.array([[0, 0]]), np.array([[2, 0]])):
        with pytest.raises(ValueError):
            notes.pool(t, bad)


# --- jobs

JOB = "id string, kind string, payload string, status string, attempts int, epoch int, last_error string, run_after int, lease_until int, created_at int, updated_at int, seq long"


def job(i, kind="link-cluster", status="queued", payload="{}", attempts=0, run_after=None, lease=None, created=0):
    return (i, kind, payload, status, attempts, 0, None, run_after, lease, created, 0, ord(i))


def log(spark, *rows):
    return spark.createDataFrame(list(rows), JOB)


def claim(spark, *rows, now=100):
    r = jobs.next_claim(log(spark, *rows), now).first()
    return r and r["id"]


def test_claims(spark):
    assert claim(spark, job("b"), job("a")) == "a" and claim(spark, job("a", created=2), job("b", created=1)) == "b"
    assert claim(spark, job("a", run_after=100)) == "a" and claim(spark, job("a", run_after=101)) is None
    assert claim(spark, job("a", status="running", lease=100)) is None and claim(spark, job("a", status="running", lease=99)) == "a"
    assert claim(spark, job("a"), job("r", "reembed", run_after=500)) is None
    assert claim(spark, job("r", "reembed"), job("a", status="running", lease=100)) is None and claim(spark, job("r", "reembed"), job("a", status="running", lease=99)) == "r"
    same, other = '{"site":"a:b","conversation_id":"c"}', '{"site":"a","conversation_id":"b:c"}'
    busy = job("a", "distill", "running", same, lease=200)
    assert claim(spark, busy, job("b", "distill", payload=same)) is None and claim(spark, busy, job("b", "distill", payload=other)) == "b"


def test_transitions(spark):
    now = jobs.claimed(log(spark, job("a")), 100, 400)
    c = now.first().asDict()
    assert (c["status"], c["attempts"], c["lease_until"]) == ("running", 1, 400) and jobs.holds(now, c)
    assert jobs.completed(now, c, 101).first()["status"] == "done" and not jobs.holds(now, c | {"epoch": 9})
    assert jobs.completed(now, c | {"attempts": 2}, 101).first()["status"] == "running"
    f = jobs.failed(now, c, "e", 101, 131).first()
    assert (f["status"], f["run_after"], f["last_error"]) == ("queued", 131, "e")
    assert jobs.failed(now, c, "e", 101, 131, fatal=True).first()["status"] == "failed"
    fifth = log(spark, job("a", status="running", attempts=5, lease=400))
    assert jobs.failed(fifth, fifth.first().asDict(), "e", 101, 131).first()["status"] == "failed"
    r = jobs.rescheduled(now, c, 150, 101).first()
    assert (r["status"], r["attempts"], r["epoch"], r["run_after"]) == ("queued", 0, 1, 150)
    g = jobs.given_back(now, c, 101).first()
    assert (g["status"], g["attempts"], g["epoch"]) == ("queued", 0, 1)
    assert jobs.renewed(now, c, 900, 101).first()["lease_until"] == 900
    assert jobs.retried(log(spark, job("a", status="failed", attempts=5)), 1).first()["attempts"] == 0


def test_backoff(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 20)], "a int")
    assert [r["s"] for r in df.select(jobs.backoff_seconds(F.col("a")).alias("s")).collect()] == [30, 60, 120, 240, 480, 1800]


def test_coalescing(spark):
    old = log(spark, job("a", payload="{}"), job("b", status="running", payload='{"x":1}'))
    new = log(spark, job("c"), job("d", payload='{"x":1}'), job("e", payload='{"x":1}'))
    assert [r["id"] for r in jobs.enqueued(old, new).collect()] == ["d"]
    with pytest.raises(ValueError):
        jobs.enqueued(old, log(spark, job("z", "nonsense")))


# --- calibration and backfill


def test_calibration_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(70, 3)).round(1)
    v[20:40] = v[0]  # many ties
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    s = np.sort([float(sum(x * y for x, y in zip(u[i], u[j], strict=True))) for i in range(70) for j in range(i + 1, 70)])
    df = spark.createDataFrame([(i, [*map(float, x)]) for i, x in enumerate(v)], "id long, embedding array<double>")
    up = lambda x: math.floor(x * 10_000 + 0.5) / 10_000
    wanted = {"x": 0.05, "most": 0.93, "all": 1.0, "none": 0.0}
    assert {r["anchor"]: r["threshold"] for r in calibrate.threshold_at(df, wanted).collect()} == {k: up(s[min(len(s) - 1, int((1 - d) * len(s) // 1))]) for k, d in wanted.items()}
    assert {r["anchor"]: r["density"] for r in calibrate.density(df, {"a": 0.5, "b": -0.25}).collect()} == pytest.approx({"a": (s >= 0.5).mean(), "b": (s >= -0.25).mean()})
    assert tuple(calibrate.summary(df).first()) == (len(s), up(s.mean()), up(s.std()))
    assert calibrate.pairwise(df).count() == len(s)
    assert calibrate.threshold_at(df.limit(0), wanted).count() == 0 and calibrate.summary(df.limit(0)).first()["pairs"] == 0


def test_few_pairs_are_summed_from_left_to_right(spark, monkeypatch):
    import pyarrow as pa

    summed, folds, dots = [], [], calibrate.dots
    monkeypatch.setattr(calibrate, "SIDE", 100)
    monkeypatch.setattr(calibrate, "dots", lambda a, b, r, c: summed.append(len(r)) or dots(a, b, r, c))
    monkeypatch.setattr(calibrate, "tiled", lambda left, right, fold, schema: folds.append(fold) or spark.createDataFrame([], schema))
    calibrate.density(spark.createDataFrame([], "id long, embedding array<double>"), {"a": 0.25, "b": 0.96})
    v = np.random.default_rng(6).normal(size=(900, 2))
    v[:60], v[60:90] = (0.6, 0.8), (0.8, 0.6)  # 0.6 * 0.8 + 0.8 * 0.6, from left to right, is 0.96
    v /= np.where(np.arange(900) < 90, 1, np.sqrt((v * v).sum(1)))[:, None]
    ids = np.arange(900)
    ids[899] = 898  # one id, which is no pair
    (found,) = folds[0](pa.array(ids), v, pa.array(ids), None)
    s = [float(v[i, 0] * v[j, 0] + v[i, 1] * v[j, 1]) for i in range(900) for j in range(i + 1, 900) if ids[i] != ids[j]]
    assert found.to_pydict() == {"anchor": ["a", "b"], "n": [sum(x >= t for x in s) for t in (0.25, 0.96)], "of": [len(s)] * 2}
    assert 60 * 30 <= sum(summed) < 60 * 30 + 40


def test_statistics_of_all_pairs_make_no_pair(spark, monkeypatch):
    def made(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(calibrate, "tiled", made)
    monkeypatch.setattr(calibrate, "PRODUCTS", 15)  # five rows at once
    v = np.random.default_rng(7).normal(size=(60, 3)) + 0.5
    ids = [*range(40), *[41] * 7, 42, 42, *range(50, 61)]
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    s = np.array([u[i] @ u[j] for i in range(60) for j in range(i + 1, 60) if ids[i] != ids[j]])
    df = spark.createDataFrame([(i, [*map(float, x)]) for i, x in [*zip(ids, v, strict=True), (None, v[0])]], "id long, embedding array<double>").repartition(3)
    up = lambda x: math.floor(x * 10_000 + 0.5) / 10_000
    assert tuple(calibrate.summary(df).first()) == (len(s), up(s.mean()), up(s.std()))
    assert tuple(calibrate.summary(df.limit(0)).first()) == (0, None, None)
    for odd in ([1.0, 2.0], [float("nan"), 0.0, 1.0]):
        with pytest.raises(Exception, match="vectors of different lengths|not finite"):
            calibrate.summary(df.unionByName(spark.createDataFrame([(99, odd)], df.schema))).collect()


@pytest.mark.parametrize("ranges", [1 << 20, 4096, 3])
def test_rank_correlation_without_a_list_of_pairs(spark, monkeypatch, ranges):
    def made(*_):
        raise AssertionError("all pairs are listed")

    if ranges > 3:  # three are too few: what is left out is too much
        monkeypatch.setattr(calibrate, "pairwise", made)
    monkeypatch.setattr(calibrate, "RANGES", ranges)
    monkeypatch.setattr(calibrate, "MOST_RANKED", 500)
    monkeypatch.setattr(calibrate, "SIDE", 16)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 5))
    v[7] = v[11] = v[30]  # ties
    w = v[:, :4] + rng.normal(size=(60, 4))
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    i, j = np.triu_indices(60, 1)
    s, t = ([float(sum(x * y for x, y in zip(u[a], u[b], strict=True))) for a, b in zip(i, j, strict=True)] for u in (unit(v), unit(w)))
    ranks = lambda x: np.argsort(np.argsort(x, kind="stable"))
    want = math.floor(np.corrcoef(ranks(s), ranks(t))[0, 1] * 10_000 + 0.5) / 10_000
    one, other = (spark.createDataFrame([(k, [*map(float, x)]) for k, x in enumerate(m)], "id long, embedding array<double>") for m in (v, w))
    assert calibrate.agreement(one, other).first()["spearman"] == pytest.approx(want, abs=1e-9)
    used = []
    monkeypatch.setattr(calibrate, "_floored", lambda x: used.append(x) or (len(used) if len(used) < 3 else math.floor(x * 10_000 + 0.5) / 10_000))
    assert calibrate.agreement(one, other).first()["spearman"] == pytest.approx(want, abs=1e-9)  # with ranks within ranges, needed or not
    assert calibrate.agreement(one.limit(0), other).first()["spearman"] is None


def test_thresholds_are_reconciled():
    assert calibrate.reconciled({"a": 0.5, "b": 0.5}, {"a": 0.51, "b": 0.6}) == {"a": 0.5, "b": 0.6}
    assert calibrate.reconciled({"a": 0.5}, None) == {"a": 0.5}


def brute_modularity(edges, of, total, resolution):
    volume, inner = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            volume[of[x]] = volume.get(of[x], 0.0) + w
        if of[a] == of[b]:
            inner[of[a]] = inner.get(of[a], 0.0) + w
    return sum(inner.get(c, 0.0) / total - resolution * (v / (2 * total)) ** 2 for c, v in volume.items())


def test_large_components_are_clustered_by_joins(spark):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(160)]
    edges = [(a, b, rng.uniform(0.7, 1.0)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and rng.random() < (0.5 if i % 8 == j % 8 else 0.02)]
    small = [("x", "y", 0.9), ("y", "z", 0.8)]
    total = sum(w for _, _, w in edges + small)
    nodes = spark.createDataFrame([(n,) for n in [*names, "x", "y", "z", "alone"]], "id string")
    links = spark.createDataFrame(edges + small + [("x", "unknown", 1.0), ("y", "x", 0.1), ("y", "y", 1.0)], "a string, b string, weight double")
    for most in 200, 0:
        found = graph.clusters(nodes, links, most_links=most)
        of = {r["id"]: r["community"] for r in found.collect()}
        assert len(of) == 164 and of["alone"] == "alone" and of["x"] == of["y"] == "x" and found.count() == 164
        for c in set(of.values()):
            assert c == min(x for x in of if of[x] == c)
        assert all(of[n] == names[int(n[1:]) % 8] for n in names)
        told = graph.modularity(links.join(nodes.withColumnRenamed("id", "b"), "b").filter("a < b"), found, total)
        assert told == pytest.approx(brute_modularity(edges + small, of, total, 2.0), abs=1e-9)
    alone = {n: of[n] for n in names}
    assert brute_modularity(edges, alone, total, 2.0) >= 0.99 * brute_modularity(edges, graph.louvain(names, edges, total), total, 2.0)


def test_clusters_of_an_empty_graph(spark):
    nodes, links = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "a string, b string, weight double")
    assert [tuple(r) for r in graph.clusters(nodes, links, most_links=0).collect()] == [("a", "a")]
    assert graph.clusters(nodes.limit(0), links, most_links=0).count() == 0


def test_spearman_breaks_ties_by_position(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 0.1), (0, 2, 0.5, 0.2), (1, 2, 0.5, 0.3)], "i int, j int, s double, t double")
    assert calibrate.spearman(df).first()["spearman"] == 1.0


def test_backfill_plan():
    assert backfill.plan(300, None, False, "subscription", False) == {"count": 50}
    assert "error" in backfill.plan(300, 10, True, "api", True) and "error" in backfill.plan(300, None, True, "subscription", True)
    assert backfill.plan(300, None, True, "api", False) == {"confirm": 300} and backfill.plan(300, None, True, "api", True) == {"count": 300}


def test_ties_are_in_the_order_of_words(spark):
    repos = ["zeta", "é", "f", "ab", "a_b", "a-b"]
    for n, first in ((6, "a_b"), (4, "ab"), (3, "é"), (1, "zeta")):
        rows = [("c", r) for r in repos[:n]]
        assert graph.dominant_repo(spark.createDataFrame(rows, "cluster string, repo string")).first()["repo"] == first
    c = spark.createDataFrame([(x, x) for x in ("zeta", "é", "f")], "id string, community string")
    assert [r["community"] for r in graph.numbered(c).orderBy("cluster").collect()] == ["é", "f", "zeta"]


def test_row_numbers(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x int, y string").repartition(7)
    got = {r["id"]: r["n"] for r in row_numbers(df, "n", F.desc_nulls_last("x"), "y", "id").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    assert row_numbers(df.limit(0), "n", "x").count() == 0
