from __future__ import annotations

import corpus_pipeline
import numpy as np
from sessionlake.llm import mixing, packing, quality, secrets, simhash


def test_stages_one_by_one_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, data).cache()
        kept[name] = (before, docs)
    for before, after in list(kept.values())[:-1]:
        assert before.columns == after.columns

    before, after = kept["quality"]
    net = quality.fit(before, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r["doc_id"] for r in before.collect() if net.scores([r["text"]])[0] >= 0.3}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < before.count()

    before, after = kept["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = [np.unique(simhash.shingle_hashes(simhash.words_of(t), 5)) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if both / max(1, len(sets[x]) + len(sets[y]) - both) >= 0.8 and label[x] != label[y]:
                a, b = sorted((label[x], label[y]))
                label = [a if k == b else k for k in label]
    want = {rows[k][0] for k in set(label)}
    got = {r["doc_id"] for r in after.collect()}
    assert want <= got and len(got - want) <= 0.02 * len(rows) and len(got) < len(rows)

    before, after = kept["secrets"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: secrets.redacted(t, secrets.find_spans(t)) for i, t in texts.items()}
    assert not any(secrets.find_spans(r["text"]) for r in after.collect())

    before, after = kept["mixing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    assert after.count() == mixing.copies(before).count() > before.count()

    before, after = kept["packing"]
    ids = sum(len(packing.encode([r["text"]])[0]) // 4 + 1 for r in before.collect())
    placed = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in placed) == ids and max(r[1] for r in placed) <= 2048 and len(placed) <= -(-ids // 2048) * 1.02 + 1


def test_run_is_all_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_steps_of_near_dedup_are_written_once(spark, monkeypatch):
    """No plan that near_dedup writes holds a step many times over, and contents meet their groups once in a pass."""
    from sessionlake.llm import components, simhash

    plans = []

    def recorded(write):
        def run(df, name):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return write(df, name)

        return run

    for module in (simhash, components):
        monkeypatch.setattr(module, "materialize", recorded(module.materialize))
    base = [f"word{i}" for i in range(200)]
    texts = [" ".join(base[:at] + ["other"] + base[at:]) for at in range(0, 200, 20)] + ["something else"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [0, 10]
    reads = [p.count("Relation [") for p in plans]
    assert max(reads) <= 20, reads
    meet = [p.count("LeftOuter, (x#") for p in plans]
    assert sum(meet) == 2, meet
