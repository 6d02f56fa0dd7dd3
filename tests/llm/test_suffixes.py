from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import suffixes
from tests.llm.fixtures import CLASHING, DOCS, docs, empty, prose, rows

L = suffixes.LENGTH


def brute(texts: list[str | None]) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                covered[i : i + L] = True
        kept = bytes(b for b, c in zip(d, covered, strict=False) if not c)
        edges = np.flatnonzero(np.diff(covered.astype(int), prepend=0))
        out.append((len(d), kept, edges[::2].tolist(), edges[1::2].tolist()))
    return out


def check(spark, texts: list, hot: int = suffixes.HOT, parts: int = 3) -> None:
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(parts)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(table, hot).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (got[i][0], bytes(got[i][1]), got[i][2], got[i][3]) == w, i


def test_hostile_rows_as_by_brute_force(spark):
    got, want = defaultdict(list), defaultdict(list)
    for r in suffixes.remove_repeats(docs(spark)).collect():
        got[r["doc_id"]].append((r["n_bytes"], bytes(r["kept"]), r["starts"], r["stops"]))
    for (doc_id, *_), w in zip(rows(), brute([r[1] for r in rows()]), strict=True):
        want[doc_id].append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def planted(seed: int) -> list[str]:
    """Passages around the length, shared by texts that differ before and after; copies with edits; repeats within a text."""
    rng = random.Random(seed)
    passages = [prose(seed + i, 100)[:n] for i, n in enumerate((150, 199, 200, 201, 260, 400, 500))]
    out = [prose(1000 * seed + i, rng.randint(0, 60)) + rng.choice(passages) + prose(2000 * seed + i, rng.randint(0, 60)) for i in range(60)]
    base = prose(seed + 77, 300)
    for _ in range(20):
        at = rng.randrange(len(base))
        out.append(base[:at] + rng.choice("xyz ") + base[at + rng.randint(0, 2) :])
    out += [base[50:260], base[:200], base[1:200], passages[4] + passages[4], "ab" * 300, "ba" * 120, "x" * 450, "x" * 199, passages[5] + "!" + passages[5][:350], base + base]
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, suffixes.HOT), (2, 3), (3, 0)])
def test_planted_passages_as_by_brute_force(spark, seed, hot):
    check(spark, planted(seed), hot)


@pytest.mark.parametrize("parts", [1, 3])
def test_copies_that_one_task_reads_are_repeats(spark, parts):
    alone, twice = prose(41, 60), prose(42, 80)
    texts = [twice, alone, twice, prose(43, 3) + twice[30:400], "short", "short", *[prose(44, 70)] * 4]
    check(spark, texts, parts=parts)


def test_long_texts_are_read_by_stretches(spark):
    shared = prose(5, 400)
    long = "".join(prose(100 + i, 3000) for i in range(60))
    texts = [long[:700_000] + shared + long[700_000:1_048_000] + shared + long[1_048_000:], long[900_000:1_300_000], "y" * 2_200_000, shared[100:700]]
    assert len(texts[0].encode()) > suffixes.STRETCH
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(table).collect()}
    assert got[2]["stops"] == [2_200_000] and got[2]["starts"] == [0] and bytes(got[2]["kept"]) == b""
    assert bytes(got[1]["kept"]) == b"" and bytes(got[3]["kept"]) == b""
    data = [t.encode() for t in texts]
    seen = Counter(hash(d[i : i + L]) for d in (data[0], data[1], data[3]) for i in range(len(d) - L + 1))
    covered = np.zeros(len(data[0]), np.int64)
    at = [i for i in range(len(data[0]) - L + 1) if seen[hash(data[0][i : i + L])] > 1]
    np.add.at(covered, at, 1)
    window = np.convolve(covered, np.ones(L, np.int64))[: len(covered)] > 0
    assert bytes(got[0]["kept"]) == np.frombuffer(data[0], np.uint8)[~window].tobytes()


def test_empty_and_clashing(spark):
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    names = (*CLASHING, "kh", "ch", "d1", "d2", "start", "stop", "ahead", "n", "kind", "spans", "kept")
    got = suffixes.remove_repeats(docs(spark).withColumns({c: F.lit("x") for c in names})).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, suffixes.remove_repeats(docs(spark)).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort_is_a_sort(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(300)] + [b"", b"a" * 40, b"a" * 41]
    group = np.array([rng.randint(-3, 3) for _ in texts])
    s = suffixes.Suffixes(texts, group)
    assert [(group[i], texts[i]) for i in s.order] == sorted(zip(group.tolist(), texts, strict=True))
    for length in (0, 1, 3, 40):
        c = s.classes(length)
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                if min(len(texts[i]), len(texts[j])) >= length:
                    assert (c[i] == c[j]) == (group[i] == group[j] and texts[i][:length] == texts[j][:length])


def test_a_failed_hash_is_found_and_done_again(monkeypatch):
    real, seeds = suffixes.Hashes, []

    class Weak(real):
        def __init__(self, data, seed=1):
            seeds.append(seed)
            super().__init__(data // 128 if seed == 1 else data, seed)

    monkeypatch.setattr(suffixes, "Hashes", Weak)
    texts = [b"abc", b"abd", b"xyz"]
    s = suffixes.Suffixes(texts, np.zeros(3, np.int64))
    assert seeds == [1, 2] and s.order.tolist() == [0, 1, 2] and s.lcp.tolist() == [0, 2, 0]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_least_places(width):
    rng = np.random.default_rng(width)
    h = rng.integers(0, 4, 57).astype(np.uint64)
    assert suffixes.least_places(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
