from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import prefixes
from tests.llm.fixtures import CLASHING
from tests.oracle import same

ROWS = "conv_id long, turn long, role string, text string"


def ordered(rows: list[tuple]) -> dict[int, list]:
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(x)] for c, x in out.items()}


def brute_rebuilt(own: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(sequences: dict[int, list]) -> set[tuple]:
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def hostile(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é😀", "x" * 3])) for c in range(60) for t in range(rng.randint(0, 12))]
    rows += [(5, None, None, None), (5, None, "user", "a"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 1, "user", "no id"), (None, None, None, None), (-3, 1, "u", "neg"), (-5, 1, "u", "neg"), (-5, 2, "u", "z"), (903, 1, "u", "no base")]
    return rows + [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(10)] + [(1000, t, "user", "y" * (t % 3)) for t in range(300)] + [(1001, t, "user", "y" * (t % 3)) for t in range(290)] + [(200, 1, "user", "z" * 2_000_000)]


def found(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def test_query_says_what_its_sql_says(spark, data):
    same(spark, prefixes.QUERIES["op11_conversation_prefix_trie"], prefixes.ORACLE_SQL["op11_conversation_prefix_trie"], data)


@pytest.mark.parametrize("length", [8, prefixes.SEGMENT])
def test_hostile_rows_as_by_brute_force(spark, length):
    table = spark.createDataFrame(hostile(), ROWS).repartition(5)
    got = found(prefixes.prefix_trie(prefixes.rebuilt(prefixes.numbered(table)), length))
    assert len(got) == len(set(got)) and set(got) == brute(brute_rebuilt(ordered(hostile())))


def test_plain_conversations(spark):
    got = found(prefixes.conversation_trie(spark.createDataFrame(hostile(2), ROWS).repartition(3), 16))
    assert len(got) == len(set(got)) and set(got) == brute(ordered(hostile(2)))


def test_empty_and_clashing(spark):
    table = spark.createDataFrame(hostile(), ROWS)
    assert prefixes.conversation_trie(table.limit(0)).count() == 0
    names = (*CLASHING, "k1", "k2", "pos", "a", "b", "n", "part", "head", "nth", "seg", "depth", "row", "top")
    assert set(found(prefixes.conversation_trie(table.withColumns({c: F.lit("x") for c in names})))) == brute(ordered(hostile()))


def test_positions_of_a_conversation_in_many_partitions(spark):
    rows = [(c, t, "u", str(t)) for c in (1, 2, 3) for t in range(2000 if c == 2 else 3)]
    table = spark.createDataFrame(rows, ROWS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixes.numbered(table)
        assert sorted((r["conv_id"], r["pos"]) for r in got.collect()) == [(c, t + 1) for c, t, _, _ in sorted(rows)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(5))
def test_trie_has_every_prefix_once(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 20))] for _ in range(200)] + [[1] * 70, [1] * 64, [1] * 63 + [2]]
    trie, tables = prefixes.ZFastTrie(1), []
    for s in sequences:
        x = np.array(s, np.int64)
        tables.append(prefixes.Sequence(0, prefixes.prefix_keys(prefixes.prefix_lanes(x, x))))
    for i in range(0, len(tables), 37):
        trie.add([(q, j, [1]) for j, q in enumerate(tables[i : i + 37], i)])
    got = {}
    for s, low, high, least, sums in trie.expanded():
        for d in range(low, high + 1):
            assert tuple(sequences[s][:d]) not in got
            got[tuple(sequences[s][:d])] = (least, sums[0])
    want = {tuple(s[:d]): 0 for s in sequences for d in range(len(s) + 1)}
    want = {k: (min(i for i, s in enumerate(sequences) if tuple(s[: len(k)]) == k), sum(tuple(s[: len(k)]) == k for s in sequences)) for k in want}
    assert got == want
    inner = [n for n in range(len(trie.extent)) if trie.parent[n] >= 0]
    assert len(trie.handles) == len(trie.names) == len(inner)
    for n in inner:
        assert trie.above[n] < prefixes.two_fattest(trie.above[n], trie.extent[n]) <= trie.extent[n]


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert prefixes.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
