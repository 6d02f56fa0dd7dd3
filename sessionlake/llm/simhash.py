"""SimHash near-duplicates, found by multi-index hashing.

Each text gets a 64-bit fingerprint over its 3-word shingles. Fingerprints at a Hamming distance of 3 or less link. By
the pigeonhole principle two such fingerprints differ by at most one bit in their upper or in their lower half, so each
half's ball of radius one is enumerated, looked up in the table of halves, and the complete distance of what is found
verified. Only distinct fingerprints take part: a group of exact copies, however large, is one row.

Null or empty text: fingerprint zero, linked like any other. Shorter texts than a shingle: one shingle of all words.
Repeated rows and equal ids share a fingerprint and hence a component. A null ``doc_id`` is kept; a component's id is
the least non-null one. Only ``doc_id`` and ``text`` are read (further columns may have any name); an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import drop_table, joined_by, materialize, merged, slices, table, text_column
from sessionlake.llm.components import connected_components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
BITS_AT_ONCE = 1 << 16


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8").lower())  # of bytes, lower() changes A-Z alone


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words where they are fewer, and none without words."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it set; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        counts += np.unpackbits(hashes[at : at + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ("doc_id", "fp"))

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(compute, "doc_id long, fp long")


#: A half that more fingerprints have than this is told apart further, by the quarters of their other half.
CROWDED = 256


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ``distinct.fp`` at most three bits apart.

    Of two halves that differ in one bit, one is the other with a set bit cleared; so it is enough to look up a half
    itself and the halves with one of its set bits cleared. Of a crowded half, the quarters of the other half are looked up along
    with it: they are at most three bits apart, so one of them at most one. A half and a quarter leave 16 bits, so no group of fingerprints
    that are compared with each other is larger than 65,536, whatever the texts are.
    """
    low = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    upper, lower = F.shiftrightunsigned("fp", 32), low("fp", 32)
    sides = F.array(*(F.struct(F.lit(i).alias("side"), h.cast("long").alias("half"), o.cast("long").alias("other")) for i, (h, o) in enumerate(((upper, lower), (lower, upper)))))
    halves = materialize(distinct.select("fp", F.explode(sides).alias("h")).select("fp", "h.*"), "halves")
    balls = lambda bits: F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(bits)))
    probes = halves.select(F.col("fp").alias("p"), "side", "other", F.explode(F.filter(balls(32), lambda bit: F.col("half").bitwiseAND(bit) == bit)).alias("bit"), "half")
    probes = probes.select("p", "side", F.col("half").bitwiseXOR(F.col("bit")).alias("half"), "other")
    crowded = materialize(halves.groupBy("side", "half").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).withColumn("crowded", F.lit(True)), "crowded")
    key, total = ["side", "half"], halves.count()
    probes, members = (joined_by(df, crowded, key, total) for df in (probes, halves))
    quarters = lambda df: df.filter("crowded").withColumn("q", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.shiftright("other", 16).alias("quarter")), F.struct(F.lit(1).alias("place"), low("other", 16).alias("quarter")))))
    asked = quarters(probes).select("p", *key, "q.place", F.explode(balls(16)).alias("bit"), "q.quarter").withColumn("quarter", F.col("quarter").bitwiseXOR(F.col("bit")))
    within = asked.join(merged(quarters(members).select("fp", *key, "q.*")), [*key, "place", "quarter"])
    alone = probes.filter("crowded IS NULL").join(merged(members.filter("crowded IS NULL")), key)
    near = alone.select("p", "fp").unionByName(within.select("p", "fp")).filter("p <> fp").filter(F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= MAX_DISTANCE)
    return near.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()


def components(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id, n) for each distinct fingerprint of ``fps(doc_id, fp)``, of n rows; ``root`` is the component's least fingerprint."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(merged(roots), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")).withColumnRenamed("size", "n")
    return joined_by(rooted.withColumnRenamed("n", "rows"), least, ["root"], distinct.count()).select("fp", "root", "component_id", F.col("rows").alias("n"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    found = materialize(components(fps).select("fp", "component_id", "n"), "found")
    return joined_by(fps, found, ["fp"], fps.count()).select("doc_id", "fp", "component_id")


#: Fingerprints of parts: tier i takes one shingle in RATE**(i+1) and has so many parts. Shingles go to parts by their hash; a
#: text uses the tiers whose parts hold about 1.5 to 12 of its shingles, so that of a near copy's parts some are whole at any length.
RATE, FIRST_PARTS, PARTS = 4, 4, 12
PART_SHINGLES = (1.5, 12)


def tiers(shingles: int) -> list[tuple[int, int, int]]:
    """(tier, rate, parts) for a text of so many distinct shingles. There are tiers for any number."""
    fitting, i, rate = [], 0, RATE
    while i == 0 or shingles >= PART_SHINGLES[0] * rate:
        if shingles < PART_SHINGLES[1] * rate:
            fitting.append((i, rate, PARTS if i else FIRST_PARTS))
        i, rate = i + 1, rate * RATE
    return fitting


def part_keys(hashes: np.ndarray) -> list[int]:
    """The SimHash fingerprints of a text's parts, each mixed with its tier's and part's number, as signed 64-bit numbers."""
    hashes = np.unique(hashes)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = mixed >> np.uint64(40) | mixed << np.uint64(24)
    keys = []
    for i, rate, parts in tiers(len(hashes)):
        part = mixed % np.uint64(rate)
        for k in np.unique(part[part < parts]).tolist():
            keys.append((majority(hashes[part == k]) ^ (i * 64 + k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return np.array(keys, np.uint64).view(np.int64).tolist()


#: Bins of a sketch at most; contents in a block of a bucket; partners of a content that the first pass over buckets asks for.
SKETCH_BINS, BLOCK, FIRST_PARTNERS = 512, 1024, 4


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a text's distinct shingles fall in each bin. Two texts share at most the sum of the lesser counts."""
    bins = min(SKETCH_BINS, max(16, 1 << (len(hashes) // 2).bit_length()))
    counts = np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""  # without counts, nothing is ruled out


def possible(size: np.ndarray, sketches: list[bytes], roots: np.ndarray, side: np.ndarray, least: float, limit: int | None) -> Iterator[tuple[int, int]]:
    """Pairs of contents of different roots that sizes and sketches let be similar; of sides 0 and 1, or all where a side is 2.

    No pair at ``least`` or more is ruled out. With a ``limit``, a content gets its first so many partners only.
    """
    bins = min((len(s) // 2 for s in sketches if s), default=1)
    counts = np.array([np.frombuffer(s, "<u2").reshape(-1, bins).sum(0, dtype=np.int64) if s else np.full(bins, n) for s, n in zip(sketches, size.tolist(), strict=True)])
    whole = bool((side == 2).any())
    others = np.arange(len(size)) if whole else np.flatnonzero(side == 1)
    for i in range(len(size)) if whole else np.flatnonzero(side == 0).tolist():
        js = others[others > i] if whole else others
        js = js[(roots[js] != roots[i]) & (np.minimum(size[js], size[i]) >= (least - 1e-9) * np.maximum(size[js], size[i]))]
        both = np.minimum(counts[js], counts[i]).sum(1)
        for j in js[both >= (least - 1e-9) * (size[js] + size[i] - both)][:limit].tolist():
            yield i, j


def unsettled(keyed: DataFrame, near: DataFrame, contents: DataFrame, roots: DataFrame, least: float, limit: int | None) -> DataFrame:
    """(x, y), x < y: pairs of contents that share a bucket, are of different ``roots(x, root)``, and may be similar.

    Buckets are those of ``keyed(x, key)``, and the contents of two ``near(a, b)`` fingerprints. Those of one root, and
    those of two contents, are settled. In the others, contents of one root (that of the least content) meet
    only the rest, and the rest meet each other, by salted blocks: a task holds two blocks, without texts.
    """
    rooted = materialize(contents.select(F.col("content").alias("x"), "fp").join(merged(roots), "x", "left").select("x", "fp", F.coalesce("root", "x").alias("root")), "rooted")
    by_fp = rooted.groupBy("fp").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    of = lambda end: by_fp.select(F.col("fp").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "lo", "hi")))
    mixed = near.join(merged(of("a")), "a").join(merged(of("b")), "b").filter("n_a + n_b > 2 AND least(lo_a, lo_b) <> greatest(hi_a, hi_b)")
    ends = mixed.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64("a", "b").alias("key"))
    shared = materialize(keyed.join(merged(rooted), "x").select("key", "x", "root").unionByName(rooted.join(merged(ends), "fp").select("key", "x", "root")), "shared")
    buckets = shared.groupBy("key").agg(F.min_by("root", "x").alias("main"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 2 AND lo <> hi")
    members = materialize(shared.join(merged(buckets.select("key", "main")), "key").select("key", "x", "root", (F.col("root") == F.col("main")).alias("main")), "members")
    for done in (rooted, shared):
        drop_table(done)
    blocks = lambda own: F.ceil(F.count_if(own) / BLOCK).cast("long")
    placed = members.join(merged(members.groupBy("key").agg(blocks(~F.col("main")).alias("rest"), blocks(F.col("main")).alias("mains"))), "key")
    own = F.pmod(F.xxhash64("x"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rest")))
    group = lambda kind, i, j, side: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("group"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda count, make: F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), make)
    apart = lambda t: F.when(t == F.col("own"), 2).when(F.col("own") < t, 0).otherwise(1)
    rest = F.concat(upto("rest", lambda t: group(0, F.least("own", t), F.greatest("own", t), apart(t))), upto("mains", lambda t: group(1, F.col("own"), t, 0)))
    dealt = placed.withColumn("own", own).withColumn("g", F.explode(F.when(F.col("main"), upto("rest", lambda t: group(1, t, F.col("own"), 1))).otherwise(rest)))
    described = dealt.select("g.group", "g.side", "x", "root").join(merged(contents.select(F.col("content").alias("x"), "size", "sketch")), "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, at = [], [], None

        def written() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.string()), pa.array([max(p) for p in found], pa.string())], ("x", "y"))
            found.clear()
            return out

        def settle() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                side, x, root, size, sketches = zip(*rows, strict=True)
                for i, j in possible(np.array(size), sketches, np.array(root), np.array(side), least, limit):
                    found.append((x[i], x[j]))
                    if len(found) >= 10_000:
                        yield written()
            rows.clear()

        for batch in slices(batches):
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != at:
                    yield from settle()
                    at = group
                rows.append(row)
        yield from settle()
        yield written()

    in_groups = described.select("group", "side", "x", "root", "size", "sketch").repartition("group").sortWithinPartitions("group", "x")
    return in_groups.mapInArrow(compare, "x string, y string").distinct()


def similarity(a: str, b: str, shingle: int) -> float:
    """Jaccard similarity of the sets of shingles; of two texts without words, 1."""
    x, y = (np.unique(shingle_hashes(words_of(t), shingle)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the digest ``__content`` of their words, and (content, root) of the contents that are similar to others.

    Three bits of 64 find very close texts only. So next to the whole fingerprints, those of parts are looked up as well:
    contents that share a fingerprint of either kind (whole ones may be three bits apart) are a bucket. First all of a
    bucket meet the least of it. Then those that are not in one group yet meet each other, until all pairs of a bucket are
    either compared, or in one group, or ruled out by sizes and sketches; a pass with few partners each goes before, so that
    large groups close early. Candidates link where their shingles' Jaccard similarity is at least ``least``. Equal contents
    are one from the start.
    """

    @F.pandas_udf("content string, fp long, keys array<long>, size long, sketch binary")
    def describe(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            hashes = shingle_hashes(words, shingle)
            own = np.unique(hashes)
            rows.append((hashlib.sha1(b" ".join(words)).hexdigest(), majority(hashes), part_keys(own), len(own), sketch(own)))
        contents, fps, keys, sizes, sketches = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pd.DataFrame({"content": contents, "fp": np.array(fps, np.uint64).view(np.int64), "keys": keys, "size": np.array(sizes, np.int64), "sketch": sketches})

    described = ("content", "fp", "keys", "size", "sketch")
    marked = materialize(docs.withColumn("__d", describe(text_column())).select(*docs.columns, *(F.col(f"__d.{c}").alias(f"__{c}") for c in described)), "marked")
    own_id = F.col("doc_id").cast("long")
    contents = materialize(marked.groupBy(F.col("__content").alias("content")).agg(*(F.first(f"__{c}").alias(c) for c in described[1:]), F.min(own_id).alias("id")), "contents")
    firsts = contents.groupBy("fp").agg(F.min("content").alias("content"))
    near = materialize(links(firsts.select("fp")), "near")
    first = lambda end, name: merged(firsts.select(F.col("fp").alias(end), F.col("content").alias(name)))
    whole = near.join(first("a", "x"), "a").join(first("b", "y"), "b").select("x", "y")
    keyed = contents.select(F.col("content").alias("x"), F.explode(F.concat("keys", F.array("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("x").alias("y"), F.count("*").alias("n")).filter("n > 1")
    parts = keyed.join(merged(shared), "key").filter("x <> y").select("x", "y")
    pairs = materialize(whole.unionByName(parts).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidates")

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, shingle) for x, y in zip(a, b, strict=True)], dtype=float)

    def linked(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.explode(F.array("x", "y")).alias("content")).distinct()
        asked = involved.join(merged(contents.select("content", "id")), "content").select(F.col("content").alias("c"), "id")
        found = marked.join(merged(asked), (F.col("__content") == F.col("c")) & own_id.eqNullSafe(F.col("id")), "left_semi")  # one of the copies
        texts = materialize(found.groupBy("__content").agg(F.first(text_column()).alias("text")), "candidate-texts")
        texts_of = lambda name, text: merged(texts.select(F.col("__content").alias(name), F.col("text").alias(text)))
        similar = pairs.join(texts_of("x", "s"), "x").join(texts_of("y", "t"), "y").filter(likeness("s", "t") >= least)
        return similar.select(F.col("x").alias("a"), F.col("y").alias("b"))

    edges = materialize(linked(pairs), "links")
    groups = connected_components(edges)
    for limit in (FIRST_PARTNERS, None):
        more = materialize(unsettled(keyed, near, contents, groups.select(F.col("node").alias("x"), "root"), least, limit).join(merged(pairs), ["x", "y"], "left_anti"), "candidates")
        found = materialize(linked(more), "links")
        pairs = pairs.unionByName(more)
        if found.isEmpty():
            continue
        edges = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        groups = connected_components(edges)
    return marked, groups


def keep_first(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``: that with the least id.

    Where several rows of a group have that id, or a group has no id at all, one of those rows stays.
    """
    marked, groups = similar_groups(docs, shingle, least)
    roots = groups.select(F.col("node").alias("__content"), F.col("root").alias("__root"))
    ids = marked.select("__content", F.col("doc_id").cast("long").alias("__id")).groupBy("__content").agg(F.min("__id").alias("__id"))
    rooted = ids.join(merged(roots), "__content", "left").select("__content", F.coalesce("__root", "__content").alias("__root"), "__id")
    first = rooted.groupBy("__root").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__content"))).alias("__m"))
    chosen = first.select(F.col("__m.__content").alias("__chosen"), F.col("__m.__id").alias("__first"))
    kept = marked.join(merged(chosen), (F.col("__content") == F.col("__chosen")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__first")))
    return kept.dropDuplicates(["__content"]).select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
