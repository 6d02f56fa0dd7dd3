from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import chat, mixing, warc
from tests.llm.fixtures import CLASHING, docs, empty, rows
from tests.oracle import same

# --- WARC

PAGES = "page_id long, url string, html string"


def pages(spark):
    r = [(5, "http://a/ü b", "same"), (3, "http://b", "same"), (4, "http://c", "same"), (7, None, None), (8, "", ""), (9, "http://d", "x" * 100_000), (None, "http://e", "same"), (2, "http://f", "é😀\r\n\r\nWARC/1.1\r\n"), (11, "u", "twice"), (11, "u", "twice"), (None, None, None)]
    return spark.createDataFrame(r, PAGES).repartition(2)


def run_warc(df):
    return warc.index_warc(warc.convert(warc.write_arc(df)))


@pytest.mark.parametrize("few", [0, 20_000])
def test_warc_records(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    got = defaultdict(list)
    for r in run_warc(pages(spark).withColumns({c: F.lit(1) for c in CLASHING})).collect():
        got[r["page_id"]].append(r)
    first = {}
    for p, _, html in sorted(pages(spark).collect(), key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = first.setdefault(digest, p)
        want = (len(payload), digest, "response" if head == p else "revisit", None if head == p else head)
        assert want in [tuple(r)[1:] for r in got[p]]
    assert sum(map(len, got.values())) == 11
    assert run_warc(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    name, date = "x.arc", "20010203040506"
    data = warc.arc_version_block(version, name, date) + warc.arc_document(version, name, 1, "http://a b", date, warc.http_response(1, b"one")) + warc.arc_document(version, name, 2, None, date, b"\nHTTP?\n\n")
    head, one, two = warc.read_arc(data)
    assert head["version"] == version and one["URL"] == "http://a%20b" and two["URL"] == "-" and two["document"] == b"\nHTTP?\n\n"
    record = dict(next(warc.read_warc(warc.converted(one, 1, None, None)))[0])
    assert record["WARC-Date"] == "2001-02-03T04:05:06Z" and record["WARC-Type"] == "response" and record["WARC-Payload-Digest"].startswith("sha1:")
    revisit, block = next(warc.read_warc(warc.converted(one, 1, 0, "http://first")))
    assert revisit["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n") and b"one" not in block
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-4]))
    with pytest.raises(ValueError):
        list(warc.read_arc(data.replace(f"{version} 0 -".encode(), b"7 0 -")))


def test_archives_are_readable_members(spark):
    archives = warc.convert(warc.write_arc(pages(spark))).collect()
    assert sum(len(list(warc.read_warc(gzip.decompress(r["warc"])))) for r in archives) == 11


# --- chat

ROWS = "conv_id long, turn long, role string, text string"


def conversations(spark):
    r = [
        (1, 1, "assistant", "a<|im_end|>\\|<\\|"), (1, 0, "user", "q\\"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "system", "s"), (3, 6, "user", "u"), (3, 7, "assistant", "a"), (4, 0, "assistant", "only"), (4, 0, "assistant", "only"),
        (4, None, "user", "first"), (5, 0, None, "no role"), (5, 1, "ro\nle<|\\n", "x"), (None, 0, "user", "y"), (6, 0, "user", "é😀" * 3000), (6, 1, "assistant", "z\n" * 2000), (6, 2, "assistant", " "), (7, 0, "human", "hi"),
    ]
    return spark.createDataFrame(r, ROWS).repartition(3)


def test_chat_reads_back_what_was_said(spark):
    turns = chat.canonical_turns(chat.records_of(conversations(spark).withColumn("fp", F.lit(1))))
    back = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    want = defaultdict(list)
    for c, t, role, text in conversations(spark).collect():
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert back.keys() == want.keys()
    for c, said in want.items():
        said = [(r, x) for _, _, r, x in sorted(said)]
        assert [tuple(t) for t in back[c]["turns"]] == said
        assert back[c]["loss_texts"] == [x for r, x in said if r == "assistant"]
        assert back[c]["formatted"].count("<|im_start|>") == len(said) == back[c]["formatted"].count("<|im_end|>\n")
    assert chat.summary(chat.read_chat(chat.format_chat(chat.canonical_turns(chat.records_of(conversations(spark).limit(0)))))).count() == 0


def test_layouts_are_told_by_their_fields(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": "a"}]}, {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
        {"response": "a", "prompt": "q"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = chat.canonical_turns(df).collect()
    assert len(got) == len(records) and all([tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "a")] for r in got)
    one = lambda r: [tuple(t) for t in chat.canonical_turns(spark.createDataFrame([(1, json.dumps(r))], df.schema)).first()["turns"]]
    assert one({"instruction": "i", "input": "x", "output": "o"}) == [("user", "i\n\nx"), ("assistant", "o")]
    assert one({"system": "s", "prompt": None, "response": "o"}) == [("system", "s"), ("user", ""), ("assistant", "o")]
    assert one({"messages": []}) == []
    with pytest.raises(Exception, match="no mapping for a record of the fields a,b"):
        one({"b": 1, "a": 2})


def test_chat_query_says_what_its_sql_says(spark, data):
    same(spark, chat.QUERIES["op8_chat_formatting"], chat.ORACLE_SQL["op8_chat_formatting"], data)


def test_chat_runs_no_python(spark, data):
    plan = chat.op8_chat_formatting(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- mixing


def test_exponent_meets_its_aim():
    tokens = {"a": 9000, "b": 900, "c": 100}
    m = mixing.temperature(tokens, max_repeats=4.0)
    assert 0 < m.exponent < 1 and abs(max(m.repeats.values()) - 4) < 1e-6 and min(m.repeats.values()) == pytest.approx(1)
    assert mixing.temperature(tokens, max_repeats=1000).exponent == 0 and mixing.temperature(tokens, max_repeats=1.0).exponent == pytest.approx(1)
    m = mixing.temperature(tokens, target_entropy=0.8)
    assert mixing.entropy(m.weights) == pytest.approx(0.8) and math.fsum(m.weights.values()) == pytest.approx(1)


def test_mixture_reads_its_budget(spark):
    made = docs(spark, extra=True)
    got = [r.asDict() for r in mixing.copies(made).collect()]
    tokens = defaultdict(int)
    for _, text, _, source, _ in rows():
        tokens[source or ""] += len((text or "").split()) + 1
    m = mixing.temperature(dict(tokens))
    read, times = defaultdict(int), defaultdict(list)
    for r in got:
        read[r["source"] or ""] += r["__tokens"]
        times[r["doc_id"], r["text"], r["source"]].append(r["__epoch"])
    longest = {s: max(len((t or "").split()) + 1 for _, t, _, x, _ in rows() if (x or "") == s) for s in tokens}
    for s in tokens:
        target = m.weights[s] * m.budget
        assert target - 2 * longest[s] <= read[s] <= target + 1e-6, s
    assert {(r[0], r[1], r[3]) for r in rows()} == set(times) and all(min(e) == 1 for e in times.values())
    assert mixing.mix(made).columns == made.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.copies(empty(spark)).count() == 0


def test_partial_epoch_follows_the_permutation(spark):
    """Brute force: in the order of blocks and places, documents are read until the budget ends."""
    d = spark.createDataFrame([(i, "w " * (i % 7), "big" if i < 150 else "small") for i in range(200)], "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.copies(d, max_repeats=1.6).collect()]
    tokens = defaultdict(int)
    for i in range(200):
        tokens["big" if i < 150 else "small"] += i % 7 + 1
    m = mixing.temperature(dict(tokens), max_repeats=1.6)
    rest = math.floor((m.repeats["small"] - 1) * tokens["small"])
    second = sorted((r["__block"], r["__order"], r["__tokens"]) for r in got if r["source"] == "small" and r["__epoch"] == 2)
    assert sum(t for *_, t in second) <= rest < sum(t for *_, t in second) + 7
    keyed = {r["doc_id"]: r for r in d.withColumns({"__key": F.xxhash64("doc_id", "text"), "e": F.lit(2).cast("long")}).withColumns({"b": mixing.drawn(F.col("e"), "block") % (math.isqrt(49) + 1), "o": mixing.drawn(F.col("e"), "order")}).collect()}
    order = sorted((r["b"], r["o"], r["doc_id"] % 7 + 1) for r in keyed.values() if r["source"] == "small")
    want, spent = [], 0
    for b, o, t in order:
        spent += t
        if spent > rest:
            break
        want.append((b, o, t))
    assert second == want


def test_gzip_members_are_read_one_by_one():

    import random

    rng = random.Random(5)
    parts = [b"", b"a", rng.randbytes(70_000), b"b" * 300_000, rng.randbytes(3)]
    stored = b"".join(gzip.compress(p, 1, mtime=0) for p in parts)
    for step in (1000, 1 << 16, 1 << 24):
        assert list(warc.members(stored, step)) == parts
    with pytest.raises(ValueError):
        list(warc.members(stored[:-4]))
