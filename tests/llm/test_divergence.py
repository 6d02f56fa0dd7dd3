from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import divergence
from tests.llm.fixtures import CLASHING, DOCS, docs, empty, rows
from tests.oracle import same

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(table: list[tuple], least: int, top: int = 50) -> set[tuple]:
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in table:
        lang, source = lang or "", source or ""
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang, source].update(terms)
        documents[lang].update([*terms])
    out = set()
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = {}
        own = [s for x, s in counts if x == lang]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])
        for s, c in [(s, counts[lang, s]) for s in own] + [(None, whole)]:
            total = sum(c[t] for t in kept) + 5 * len(kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        for s in own:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            more = sorted((share[None][t] - share[s][t], t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(more[:top])}
    return out


def found(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def test_query_says_what_its_sql_says(spark, data):
    same(spark, divergence.QUERIES["op13_source_divergence"], divergence.ORACLE_SQL["op13_source_divergence"], data)


@pytest.mark.parametrize(("least", "limit"), [(1, 1), (2, 3000), (30, 1 << 20), (1000, 1)])
def test_hostile_rows_as_by_brute_force(spark, least, limit):
    got = found(divergence.audit(docs(spark), least, limit))
    assert len(got) == len(set(got)) and set(got) == brute(rows(), least)


def test_many_sources_meet_in_tiles(spark):
    table = [(i, f"a b{i % 7} b{i % 3} " + "c " * (i % 5), "en", f"s{i % 300}", 0) for i in range(600)]
    got = found(divergence.audit(spark.createDataFrame(table, DOCS).repartition(3), 2))
    assert len(got) == len(set(got)) and set(got) == brute(table, 2)


def test_long_texts_and_ties(spark):
    long = "x" * (3 << 20)
    table = [(1, f"{long} Ab-cd " * 2 + "é" * 2_000_000, "en", "a", 0), (1, f"{long} ab", "en", "b", 0), (1, "cd é", "en", "b", 0), (2, long + "x", "en", "c", 0)] * 2
    assert set(found(divergence.audit(spark.createDataFrame(table, DOCS), 2))) == brute(table, 2)


def test_empty_and_clashing(spark):
    assert divergence.audit(empty(spark)).count() == 0
    extra = divergence.audit(docs(spark).withColumns({c: F.lit("x") for c in (*CLASHING, "slot", "n", "ix", "term", "shard", "item", "rank", "total", "v", "block", "left")}), 2)
    assert set(found(extra)) == brute(rows(), 2)


@pytest.mark.parametrize("n", [1, 2, 3, 500, 5000])
def test_hashes_are_perfect_and_know_their_keys(n):
    keys = [f"w{i}".encode() * (1 + i % 30) for i in range(n)]
    seed, displacements, slots = divergence.perfect(keys)
    assert sorted(slots.tolist()) == list(range(n))
    by_slot = [keys[i] for i in np.argsort(slots)]
    d = divergence.Dictionary([{"shards": 1, "shard": 0, "seed": seed, "displacements": displacements, "keys": [divergence.stored(k) for k in by_slot]}])
    assert d.slots(keys).tolist() == slots.tolist()
    assert set(d.slots([b"none", b"w", b"\xc3\xa9", b"w0" * 31]).tolist()) == {-1}


def test_terms_are_whole_over_stretches(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 5)
    text = "abc Defghijkl m é.ééééé\n" * 7 + "abcdefghijklmnop"
    assert [w.decode() for words in divergence.terms_of(text) for w in words] == TERM.findall(text.translate(LOWER))
