"""How far the sources of a language lie apart in their words: counts by sharded minimal perfect hashes.

A first pass counts in how many documents of a language each term occurs, exactly; terms of enough documents are kept.
The kept terms of a language are dealt by hash to shards of some 2000. A task makes a shard's minimal perfect hash, by
displacing the buckets of its terms until all have slots of their own, and stores the terms in the order of these slots.
The shards are broadcast, in as many rounds as keep each within ``BROADCAST_BYTES``; a second pass over the texts looks
terms up, verifies that the key stored in the slot is the term, and adds to dense counts by slot, an array a group. Only
counts that are not zero leave a task. Distances between sources are sums over blocks of terms and tiles of sources.

All numbers are whole: a share is 1 + floor(10^9 (count + 5) / (N + 5 V)).

Null text, lang or source count as empty, so that '' is a language and a source like any other. Repeated rows and equal
ids count each by itself. Texts may be of any length, as they are read by stretches. Only ``text``, ``lang`` and ``source``
are read (further columns may have any name); an empty table gives an empty result. A language without kept terms has
pairs of distance 0 and no terms.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, slices, table, text_column

LEAST_DOCUMENTS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
SHARD_TERMS = 2048
#: Keys longer than this are stored as digests, so that a shard has a greatest size.
LONGEST_KEY = 64
BROADCAST_BYTES = 64 << 20
#: What a task holds at most before it passes counts on: distinct terms not yet looked up, and dense slots.
HELD_TERMS, HELD_SLOTS = 1 << 18, 1 << 22
STRETCH = 1 << 20
TERM_BLOCK, SOURCE_TILE = 1024, 128
#: ASCII letters become lower case, other ASCII blank; bytes of other characters stay.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, by stretches."""
    line, start = text.encode("utf-8").translate(LETTERS), 0
    while start < len(line):
        stop = start + STRETCH
        if stop < len(line):
            cut = line.rfind(b" ", start, stop)
            stop = cut if cut > start else (line.find(b" ", stop) + len(line) + 1) % (len(line) + 1)
        yield line[start:stop].split()
        start = stop


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(text_column(c).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term): terms in at least ``least`` documents of their language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def passed() -> pa.RecordBatch:
            langs, words, n = zip(*((lang, w, k) for lang, c in held.items() for w, k in c.items()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ("lang", "term", "n"))

        for batch in slices(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held[lang].update({w for words in terms_of(text) for w in words})
            if sum(map(len, held.values())) >= HELD_TERMS:
                yield passed()
                held.clear()
        if any(held.values()):
            yield passed()

    counted = _read(docs).select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


# --- minimal perfect hashes


def mixed(hashes: np.ndarray, displacement: np.ndarray | int) -> np.ndarray:
    """Hashes of 64 bits, other ones for each displacement."""
    with np.errstate(over="ignore"):
        x = hashes + np.asarray(displacement, np.int64).astype(np.uint64) * GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(keys: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


def stored(key: bytes) -> bytes:
    """What is stored of a key: itself, or if it is long its digest behind a byte that no key has."""
    return key if len(key) <= LONGEST_KEY else b"\0" + hashlib.sha256(key).digest()


def perfect(keys: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slots) of a minimal perfect hash: ``slots[i]`` is key i's, from 0 to their number.

    There is a bucket for every two keys. The fullest are placed first, each under the least displacement that gives all its keys
    free slots; a bucket of one key has its slot written down, as -1 - slot.
    """
    n, seed = len(keys), 1
    while len(np.unique(h := hashed(keys, seed))) < n:
        seed += 1
    buckets = (mixed(h, 0) % np.uint64(-(-n // 2))).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    starts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    members = sorted(np.split(order, starts[1:]), key=len, reverse=True)
    displacements, slots, free = np.zeros(-(-n // 2), np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    single = next((i for i, m in enumerate(members) if len(m) == 1), len(members))
    for m in members[:single]:
        d = 1
        while True:
            at = (mixed(h[m], d) % np.uint64(n)).astype(np.int64)
            if free[at].all() and len(set(at.tolist())) == len(m):
                break
            d += 1
        displacements[buckets[m[0]]], slots[m], free[at] = d, at, False
    for m, at in zip(members[single:], np.flatnonzero(free).tolist(), strict=True):
        displacements[buckets[m[0]]], slots[m[0]] = -1 - at, at
    return seed, displacements, slots


def shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return (hashed(keys, 0) % np.uint64(shards)).astype(np.int64)


def perfect_shards(kept: DataFrame, per_shard: int = SHARD_TERMS) -> DataFrame:
    """(lang, shards, shard, seed, displacements, keys, terms), a row a shard; ``keys`` and ``terms`` are in the order of slots."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shards = pc.cast(batch["term"], pa.binary()).to_pylist(), batch["shards"].to_numpy()
            shard = (hashed(keys, 0) % shards.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ("lang", "term", "shards", "shard"))

    def build(group: pa.Table) -> pa.Table:
        keys = pc.cast(group["term"], pa.binary()).to_pylist()
        seed, displacements, slots = perfect(keys)
        by_slot = np.argsort(slots)
        one = lambda x, kind: pa.array([x], kind)
        return pa.table([
            group["lang"].slice(0, 1), group["shards"].slice(0, 1), group["shard"].slice(0, 1), one(seed, pa.int32()), one(displacements, pa.list_(pa.int64())),
            one([stored(keys[i]) for i in by_slot], pa.list_(pa.binary())), one([keys[i].decode() for i in by_slot], pa.list_(pa.string())),
        ], names=["lang", "shards", "shard", "seed", "displacements", "keys", "terms"])

    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("shards"))
    dealt = kept.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(deal, "lang string, term string, shards long, shard long")
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shards long, shard long, seed int, displacements array<long>, keys array<binary>, terms array<string>")


class Dictionary:
    """Some of the shards of a language; its slots are numbered through all of them."""

    def __init__(self, rows: list) -> None:
        self.shards = rows[0]["shards"]
        self.number = np.full(self.shards, -1)
        self.number[[r["shard"] for r in rows]] = np.arange(len(rows))
        self.seed = np.array([r["seed"] for r in rows], np.int64)
        self.size = np.array([len(r["keys"]) for r in rows], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.buckets = np.array([len(r["displacements"]) for r in rows], np.int64)
        self.first = np.cumsum(self.buckets) - self.buckets
        self.displacements = np.concatenate([np.array(r["displacements"], np.int64) for r in rows])
        self.keys = pa.concat_arrays([pa.array(r["keys"], pa.binary()) for r in rows])
        #: The shard above, the slot within it below.
        self.names = np.concatenate([(r["shard"] << 32) + np.arange(len(r["keys"])) for r in rows])

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, or -1 where it is not the key that is stored there."""
        shard = self.number[shard_of(keys, self.shards)]
        out, here = np.full(len(keys), -1), np.flatnonzero(shard >= 0)
        shard = shard[here]
        for seed in np.unique(self.seed[shard]).tolist():
            own = self.seed[shard] == seed
            at, s = here[own], shard[own]
            h = hashed([keys[i] for i in at.tolist()], seed)
            d = self.displacements[self.first[s] + (mixed(h, 0) % self.buckets[s].astype(np.uint64)).astype(np.int64)]
            slot = self.base[s] + np.where(d < 0, -1 - d, (mixed(h, d) % self.size[s].astype(np.uint64)).astype(np.int64))
            # A displacement of a bucket of one may point anywhere for other keys, so the place is checked before the key.
            equal = pc.equal(self.keys.take(pa.array(slot)), pa.array([stored(keys[i]) for i in at.tolist()], pa.binary()))
            out[at] = np.where(equal.to_numpy(zero_copy_only=False), slot, -1)
        return out


def rounds(shards: DataFrame, limit: int = BROADCAST_BYTES) -> list[tuple]:
    """Which shards are broadcast together: from which (lang, shard) to which, each of at most ``limit`` bytes, or of one shard."""
    size = F.aggregate("keys", F.lit(0).cast("long"), lambda n, k: n + F.octet_length(k) + 8) + 8 * F.size("displacements")
    out, room = [], 0
    for lang, shard, n in sorted(map(tuple, shards.select("lang", "shard", size).collect())):
        if not out or n > room:
            out.append(((lang, shard), (lang, shard)))
            room = limit
        out[-1] = out[-1][0], (lang, shard)
        room -= n
    return out


def recount(docs: DataFrame, shards: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, slot, n): occurrences of the kept terms in each group; ``slot`` is shard << 32 and the place there. None are zero."""
    spark, found = docs.sparkSession, []
    place = F.struct("lang", "shard")

    def at(lang: str, shard: int) -> Column:
        return F.struct(F.lit(lang).alias("lang"), F.lit(shard).cast("long").alias("shard"))

    for first, last in rounds(shards, limit):
        chosen = shards.filter((place >= at(*first)) & (place <= at(*last)))
        by_lang = defaultdict(list)
        for r in chosen.drop("terms").sort("lang", "shard").collect():
            by_lang[r["lang"]].append(r.asDict())
        shared = spark.sparkContext.broadcast(dict(by_lang))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            dictionaries = {lang: Dictionary(rows) for lang, rows in shared.value.items()}
            held: dict[tuple, Counter] = defaultdict(Counter)
            dense: dict[tuple, np.ndarray] = {}

            def passed() -> Iterator[pa.RecordBatch]:
                for (lang, source), counts in dense.items():
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(dictionaries[lang].names[at]), pa.array(counts[at])], ("lang", "source", "slot", "n"))
                dense.clear()

            def looked_up() -> Iterator[pa.RecordBatch]:
                for key, counter in held.items():
                    words = dictionaries[key[0]]
                    if key not in dense:
                        if sum(map(len, dense.values())) >= HELD_SLOTS:
                            yield from passed()
                        dense[key] = np.zeros(len(words.names), np.int64)
                    slots, n = words.slots([*counter]), np.fromiter(counter.values(), np.int64, len(counter))
                    dense[key][slots[slots >= 0]] += n[slots >= 0]
                held.clear()

            for batch in slices(batches):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if lang in dictionaries:
                        for words in terms_of(text):
                            held[lang, source].update(words)
                if sum(map(len, held.values())) >= HELD_TERMS:
                    yield from looked_up()
            yield from looked_up()
            yield from passed()

        found.append(_read(docs).mapInArrow(count, "lang string, source string, slot long, n long"))
    out = found[0] if found else spark.createDataFrame([], "lang string, source string, slot long, n long")
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


# --- distances


def share(n: str) -> Column:
    """1 + floor(SCALE (n + PRIOR) / total), by whole decimals; 1 where nothing is counted."""
    return F.expr(f"1 + coalesce(CAST((CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {PRIOR} AS DECIMAL(20,0))) div CAST(nullif(total, 0) AS DECIMAL(20,0)) AS BIGINT), 0)")


def numbered_sources(docs: DataFrame, shards: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, ix, sources, v, total, zero): the groups, numbered within their language; ``zero`` is the share of a term without occurrences."""
    groups = _read(docs).select("lang", "source").distinct()
    v = shards.groupBy("lang").agg(F.sum(F.size("keys")).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    known = groups.join(v, "lang", "left").join(n, ["lang", "source"], "left").withColumns({"v": F.coalesce("v", none), "n": F.coalesce("n", none)})
    known = known.withColumn("total", F.col("n") + PRIOR * F.col("v")).withColumn("zero", share("0"))
    sized = known.join(known.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    return sized.withColumn("ix", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).select("lang", "source", "ix", "sources", "v", "total", "zero")


def _distances(group: pa.Table) -> pa.Table:
    """Of one block of terms and one pair of tiles: the summed differences of the sources of one tile from those of the other."""
    lang, left, right = (group[c][0] for c in ("lang", "left", "right"))
    ix, slot, p = (group[c].to_numpy() for c in ("ix", "slot", "p"))
    known = slot < 0
    sources, zeros = ix[known], p[known]
    order = np.argsort(sources)
    sources, zeros = sources[order], zeros[order]
    terms, row = np.unique(slot[~known], return_inverse=True)
    shares = np.repeat(zeros[:, None], len(terms), 1)
    shares[np.searchsorted(sources, ix[~known]), row] = p[~known]
    tile = sources // SOURCE_TILE
    a, b = np.flatnonzero(tile == left.as_py()), np.flatnonzero(tile == right.as_py())
    away = np.array([np.abs(shares[b] - shares[i]).sum(1) for i in a]).reshape(len(a), len(b))
    x, y = np.repeat(sources[a], len(b)), np.tile(sources[b], len(a))
    away, other = away.ravel(), x != y
    x, y, away = x[other], y[other], away[other]
    if left.as_py() != right.as_py():
        x, y, away = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([away, away])
    return pa.table({"lang": pa.array([lang.as_py()] * len(x), pa.string()), "ix": pa.array(x, pa.int32()), "other": pa.array(y, pa.int32()), "value": pa.array(away, pa.int64())})


def source_distances(sources: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, ix, other, value) for all pairs of sources of a language, both ways; ``shares(lang, ix, slot, p)`` are those of terms that occur."""
    blocks = F.greatest(F.ceil(F.col("v") / TERM_BLOCK), F.lit(1)).cast("long")
    sized = sources.select("lang", "ix", "sources", blocks.alias("blocks"), "zero")
    zeros = sized.select("lang", "ix", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("slot"), F.col("zero").alias("p"))
    cells = shares.join(sized, ["lang", "ix"]).select("lang", "ix", "sources", F.pmod(F.xxhash64("slot"), F.col("blocks")).alias("block"), "slot", "p")
    tile = (F.col("ix") / SOURCE_TILE).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), ((F.col("sources") - 1) / SOURCE_TILE).cast("int")), lambda t: F.struct(F.least(t, tile).alias("left"), F.greatest(t, tile).alias("right")))
    dealt = cells.unionByName(zeros).select("lang", "ix", "block", "slot", "p", F.explode(tiles).alias("t")).select("lang", "block", "t.left", "t.right", "ix", "slot", "p")
    return dealt.groupBy("lang", "block", "left", "right").applyInArrow(_distances, "lang string, ix int, other int, value long").groupBy("lang", "ix", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = BROADCAST_BYTES, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources (``pair``), and the terms that a source has more of (``term``)."""
    shards = materialize(perfect_shards(kept_terms(docs, least)), "shards")
    counts = materialize(recount(docs, shards, limit), "counts")
    sources = materialize(numbered_sources(docs, shards, counts), "sources")
    shares = counts.join(sources, ["lang", "source"]).select("lang", "source", "ix", "slot", share("n").alias("p"))
    names = sources.select("lang", "ix", "source")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = "lang", "source", "part", "item", "value", "rank"
    pairs = source_distances(sources, shares.drop("source")).join(names, ["lang", "ix"]).join(names.select("lang", F.col("ix").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order)).select(*columns)
    whole = sources.groupBy("lang").agg((F.sum("total") - (F.count("*") - 1) * PRIOR * F.first("v")).alias("total"))
    of_lang = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "slot", share("n").alias("q"))
    spelled = shards.select("lang", "shard", F.posexplode("terms").alias("at", "item")).select("lang", (F.shiftleft("shard", 32) + F.col("at")).alias("slot"), "item")
    more = shares.join(of_lang, ["lang", "slot"]).filter("p > q").join(spelled, ["lang", "slot"])
    terms = more.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(*columns)
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {
    "op13_source_divergence": rf"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
per AS (SELECT id, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term FROM per GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v FROM d LEFT JOIN size USING (lang)),
c AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM per SEMI JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + {PRIOR} * g.v AS total
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + {PRIOR}) // CAST(total AS HUGEINT) AS p FROM f),
q AS (SELECT lang, term, 1 + CAST({SCALE} AS HUGEINT) * (n + {PRIOR}) // CAST(sum(n) OVER (PARTITION BY lang) + {PRIOR} * v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN size USING (lang)),
away AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN away a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}""",
}
