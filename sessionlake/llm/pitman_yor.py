"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Every word is a context: its restaurant seats the tokens that follow it (those at a document's beginning follow an end).
All contexts share one parent, the restaurant of words, whose customers are the contexts' tables; its own tables draw from
a base that is even over the words of training and as many unseen ones as Chao's estimate expects, which together are one
event. The numbers of contexts and of their dishes grow with the corpus: nothing of the model is capped or broadcast.

In each sweep the seating of every dish is sampled given all others: the number of tables for its customers, in proportion
to the generalised Stirling number (the seatings with so many tables) and the weight of a new table. That is a Gibbs move
of all customers of a dish at once. It is drawn exactly up to ``EXACT`` customers, and beyond from bins of the same
distribution by a saddle point, so that a dish costs the same however many its customers are. Tables stay from sweep to
sweep: the parent's customers, a restaurant's tables and the probabilities are those of the last one. Restaurants that are
sampled in parallel see each other's tables of the sweep before. Predictive probabilities are averaged over the sweeps
after the burn-in.

Documents are numbered in blocks with a vocabulary of their own. What blocks know of a pair of words (context and dish) or
of a word goes, as sorted arrays, to the group that the hash of both words, or of the word, names; so neither a common
context nor a common word meets in one task. Groups grow in number with the texts. A dish with one customer has one table
and is left out of the sweeps. Words are told by 56 bits of their hash. The same documents give the same scores however they
are partitioned, but that a null id may stand for several documents.

``score`` has the events of the base score: each word of the training vocabulary, and one for all other words.

Null text counts as empty: its one token is the end. Repeated rows and ids are documents of their own, and each counts in
training. A null id is one that is written as nothing. Without training documents every word is the unknown one, of
probability one. Only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import crc_remainder, drop_table, materialize, materialize_kinds, slices, table, text_column

HELD_OUT_OF, HELD_OUT = 7, 2
END = b"\n"  #: a token, as no word can hold it; also the context of a document's first token
BLOCK_TOKENS = 5_000_000
GROUP_CHARS = 32_000_000  #: of text, for each group of pairs or words
DOCUMENTS_AT_ONCE = 256
CONTEXT_STRENGTH, WORD_STRENGTH = 2.0, 1.0
SWEEPS, BURN_IN = 3, 1
SAMPLES = SWEEPS - BURN_IN
#: Customers of a dish up to which tables are drawn from all Stirling numbers; tables up to which these are summed exactly; bins.
EXACT, SUMMED, BINS = 128, 48, 64

PARCEL = "kind string, to long, sender long, data binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- seatings


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers (rows) at t tables (columns), by weight."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            old = np.where(t <= c, s[c] + np.log(np.maximum(c - discount * t, 0)), -np.inf)
            s[c + 1] = np.logaddexp(old, np.concatenate([[-np.inf], s[c, :-1]]))
    return s[:, : most + 1]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For arguments of about ten and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same numbers by the saddle point of their generating function ``(1 - (1 - x)**d)**t``, at ``x = 1 - exp(-y)``."""
    low, high = np.zeros(t.shape), np.broadcast_to(np.log(2 * c / t + 2) / (1 - discount) + 2, t.shape)
    for _ in range(50):  # y by halving: d (e**y - 1) / (e**(d y) - 1) grows with it from 1
        y = (low + high) / 2
        below = math.log(discount) + np.log(np.expm1(y)) - np.log(np.expm1(discount * y)) < np.log(c / t)
        low, high = np.where(below, y, low), np.where(below, high, y)
    y = np.maximum(y, 1e-9)
    slope = discount * np.exp(y) / np.expm1(discount * y) - discount**2 * np.exp(discount * y) * np.expm1(y) / np.expm1(discount * y) ** 2
    spread = np.maximum(t * slope * np.expm1(y), 0) + 1 / 6  # as in Gosper's form of the factorial
    factorial = log_gamma(t + 10.0) - sum(np.log(t + k) for k in range(1, 10))
    return log_gamma(c + 1.0) - factorial - t * math.log(discount) + t * np.log(-np.expm1(-discount * y)) - c * np.log(-np.expm1(-y)) - 0.5 * np.log(2 * math.pi * spread)


def log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same numbers for over ``EXACT`` customers, but for a factor of each row (``c``: column, ``t``: matrix of whole numbers).

    For few tables by their alternating sum, as far as it keeps its digits, joined to the saddle points of the others.
    """
    out = log_saddle(c, t, discount)
    rate = c[:, 0] ** -discount
    upto = np.clip(np.floor(25 / np.log((1 + rate) / (1 - rate))), 2, SUMMED).astype(np.int64)
    few = np.flatnonzero((t <= upto[:, None]).any(1))
    if len(few):
        j = np.arange(1, SUMMED + 1)
        inverse = np.array([0.0 if float(x * discount).is_integer() else 1 / math.gamma(-x * discount) for x in j])
        terms = np.exp(log_gamma(c[few] - j * discount) - log_gamma(c[few] - discount)) * inverse
        exact = np.empty(terms.shape)
        for k in j.tolist():
            signs = np.array([(-1) ** i * math.comb(k, i) for i in range(1, k + 1)], float)
            exact[:, k - 1] = np.log(np.maximum(terms[:, :k] @ signs, 1e-300)) - math.lgamma(k + 1) - k * math.log(discount)
        last = upto[few, None]
        exact += log_saddle(c[few], last.astype(float), discount) - np.take_along_axis(exact, last - 1, 1)
        own = np.minimum(t[few], last).astype(np.int64)
        out[few] = np.where(t[few] <= last, np.take_along_axis(exact, own - 1, 1), out[few])
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables, drawn for each dish from their distribution given its customers and the weight of a new table."""
    tables, a = np.minimum(customers, 1), np.maximum(weight, 1e-300)
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    stirling, log_a = log_stirling(discount), np.log(a)
    ends = np.flatnonzero(np.diff(customers[small], append=-1)) + 1
    for start, stop in zip([0, *ends][:-1], ends, strict=True):
        c = int(customers[small[start]])
        t = np.arange(1, c + 1)
        for at in range(start, stop, step := max(1, 1_000_000 // c)):
            own = small[at : min(at + step, stop)]
            tables[own] = 1 + drawn(stirling[c, 1 : c + 1] + log_a[own, None] * t, rng)
    large = np.flatnonzero(customers > EXACT)
    for at in range(0, len(large), 20_000):
        own = large[at : at + 20_000]
        tables[own] = seat_large(customers[own].astype(float), a[own], discount, rng)
    return tables


def drawn(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of each row, the number of a column, in proportion to the exponentials."""
    upto = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    return np.minimum((upto < rng.random((len(logs), 1)) * upto[:, -1:]).sum(1), logs.shape[1] - 1)


def seat_large(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws from ``BINS`` bins around the likeliest number of tables ``a/d (1 - e**(-d y))``, where ``(e**y - 1) e**(-d y) = c/a``."""
    low, high = np.zeros(len(c)), np.log1p(c / a) / (1 - discount)
    for _ in range(60):
        y = (low + high) / 2
        below = np.log(np.expm1(y)) - discount * y < np.log(c / a)
        low, high = np.where(below, y, low), np.where(below, high, y)
    mode = np.clip(-a / discount * np.expm1(-discount * y), 1, c)
    reach = 8 * np.sqrt(mode) + 8
    first = np.maximum(1, np.floor(mode - reach))
    width = np.maximum(1, np.ceil((np.minimum(c, mode + reach) - first + 1) / BINS))
    bins = first[:, None] + width[:, None] * np.arange(BINS)
    middle = np.minimum(np.floor(bins + (width[:, None] - 1) / 2), c[:, None])
    logs = log_seatings(c[:, None], middle, discount) + middle * np.log(a)[:, None]
    chosen = drawn(np.where(bins <= c[:, None], logs, -np.inf), rng)
    return np.minimum(first + width * chosen + np.floor(rng.random(len(c)) * width), c).astype(np.int64)

# --- arrays in transit


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string, by the planes of their bytes, the higher of which are mostly zero."""
    import zstandard

    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<u4").tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    shapes, at, out = np.frombuffer(raw[4 : 4 + 8 * n], "<u4").reshape(-1, 2).tolist(), 4 + 8 * n, []
    for (length, size), kind in zip(shapes, kinds, strict=True):
        planes = np.frombuffer(raw[at : at + length * size], np.uint8).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += length * size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which are smaller; :func:`upto` is the way back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def upto(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def parcels(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    kind, to, sender, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(kind, pa.string()), pa.array(to, pa.int64()), pa.array(sender, pa.int64()), pa.array(data, pa.binary())], [f.split()[0] for f in PARCEL.split(", ")])


def received(found: pa.Table, kind: str | None = None) -> list[tuple[int, bytes]]:
    """(sender, data) of the parcels of a kind, by sender."""
    rows = zip(found["kind"].to_pylist(), found["sender"].to_pylist(), found["data"].to_pylist(), strict=True)
    return sorted(((s, d) for k, s, d in rows if kind in (None, k)), key=lambda r: r[0])


def in_groups(words: np.ndarray, groups: int) -> np.ndarray:
    return (words >> np.uint64(20)) % np.uint64(groups)


def pair_groups(context: np.ndarray, dish: np.ndarray, groups: int) -> np.ndarray:
    mixed = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (dish >> np.uint64(29)) ^ (dish * np.uint64(0xD6E8FEB86659FD93))
    return in_groups(mixed ^ mixed >> np.uint64(31), groups)


def each_group(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places in order) of the groups that occur."""
    order = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.diff(of[order], prepend=-1.0))
    for own in np.split(order, at[1:]) if len(of) else []:
        yield int(of[own[0]]), own


# --- blocks of documents


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8").lower().split(), END]  # of bytes: A-Z alone, and blanks are 20 and 09 to 0D


def pairs_of(ids: np.ndarray, lengths: np.ndarray, words: int, end: int, out: np.ndarray | None = None) -> np.ndarray:
    """Of each token its pair as one number: the context (the word before, or an end) times ``words``, and the token."""
    out = np.empty(len(ids), np.int64) if out is None else out
    out[1:] = ids[:-1]
    out[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = end
    out *= words
    out += ids
    return out


def distinct_pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ``(ids, lengths, held)`` of documents, in order, and how often each is in those not held out."""
    every, at = np.empty(sum(len(ids) for ids, _, _ in parts), np.int64), 0
    for ids, lengths, held in parts:
        own = pairs_of(ids, lengths, words, end, every[at : at + len(ids)])
        own <<= 1
        own += np.repeat(~held, lengths)
        at += len(ids)
    every.sort()
    trained = (every & 1).astype(np.uint32)
    every >>= 1
    first = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1])
    return every[first], np.add.reduceat(trained, first).astype(np.uint32)


def word_hashes(words) -> np.ndarray:
    """56 bits of each word's XXH64."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64) >> np.uint64(8)


def encode(docs: DataFrame, groups: int) -> DataFrame:
    """Parcels of blocks: their documents as numbers of the block's own vocabulary (by frequency), their words and their pairs."""

    def block_rows(block: int, numbers: dict[bytes, int], found: list) -> Iterator[pa.RecordBatch]:
        lengths, held = np.array([len(x) for _, _, x in found]), np.array([h for _, h, _ in found])
        ids, counts, at = np.empty(lengths.sum(), np.uint32), np.zeros(len(numbers), np.int64), 0
        for _, h, x in found:
            ids[at : at + len(x)] = x
            at += len(x)
        marks = [(d or 0, h + 2 * (d is None)) for d, h, _ in found]
        found.clear()
        order = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        hashes = word_hashes(numbers)[order]
        ids, at = rank[ids], 0
        for start in range(0, len(marks), DOCUMENTS_AT_ONCE):
            some, sizes = marks[start : start + DOCUMENTS_AT_ONCE], lengths[start : start + DOCUMENTS_AT_ONCE]
            stop = at + int(sizes.sum())
            counts += np.bincount(ids[at:stop][np.repeat(~held[start : start + DOCUMENTS_AT_ONCE], sizes)], minlength=len(order))
            yield from parcels([("documents", block, start, packed(np.array([d for d, _ in some], np.int64), np.array([f for _, f in some], np.uint8), sizes.astype(np.uint32), ids[at:stop]))]).to_batches()
            at = stop
        by_hash, place = np.argsort(hashes), np.empty(len(order), np.uint32)
        place[by_hash] = np.arange(len(order), dtype=np.uint32)
        hashes, counts = hashes[by_hash], counts[by_hash].astype(np.uint32)
        for group, own in each_group(in_groups(hashes, groups)):
            yield from parcels([("words", group, block, packed(by_hash[own].astype(np.uint32), steps(hashes[own]), counts[own]))]).to_batches()
        pairs, seen = distinct_pairs([(place[ids], lengths, held)], len(order), int(place[rank[numbers[END]]]))
        context, dish = (x.astype(np.uint32) for x in np.divmod(pairs, len(order)))
        for group, own in each_group(pair_groups(hashes[context], hashes[dish], groups)):
            named = np.unique(np.concatenate([context[own], dish[own]]))
            u, w = (np.searchsorted(named, x[own]).astype(np.uint32) for x in (context, dish))
            yield from parcels([("pairs", group, block, packed(steps(hashes[named]), steps(u), w, seen[own]))]).to_batches()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> defaultdict:
            numbers = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers

        block, numbers, found, tokens = TaskContext.get().partitionId() << 32, fresh(), [], 0
        for batch in slices(batches):
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.fromiter(map(numbers.__getitem__, words := tokens_of(text)), np.int32, len(words))
                found.append((doc_id, held, ids))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from block_rows(block, numbers, found)
                    block, numbers, found, tokens = block + 1, fresh(), [], 0
        if found:
            yield from block_rows(block, numbers, found)

    held = crc_remainder(F.col("doc_id").cast("long"), HELD_OUT_OF) == HELD_OUT
    return docs.select(F.col("doc_id").cast("long"), held.alias("held"), text_column().alias("text")).mapInArrow(number, PARCEL)


# --- what the corpus holds


def united(hashes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct words of all lists in order, and of each list their places there."""
    whole, places = np.unique(np.concatenate(hashes), return_inverse=True)
    return whole, np.split(places, np.cumsum([len(h) for h in hashes])[:-1])


def counted_words(words: DataFrame) -> DataFrame:
    """Of each group its words and their counts in training (``data``), with the sums that the model needs."""

    def count(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        lists = [unpacked(data, "<u4", "<u8", "<u4") for _, data in received(found)]
        whole, places = united([upto(h) for _, h, _ in lists])
        c = np.zeros(len(whole), np.int64)
        for at, (_, _, n) in zip(places, lists, strict=True):
            c[at] += n
        return pa.table([[key[0].as_py()], pa.array([packed(steps(whole), c)], pa.binary()), [int(c.sum())], *([int((c >= i).sum())] for i in (1, 2, 3))], ["to", "data", "n", "v", "twice", "thrice"])

    return words.groupBy("to").applyInArrow(count, "to long, data binary, n long, v long, twice long, thrice long")


def asked(own: int, hashes: np.ndarray, u: np.ndarray, w: np.ndarray, t: np.ndarray, groups: int) -> list[tuple[str, int, int, bytes]]:
    """To the groups of words: of each word the tables in its restaurant, and those at which it is the dish."""
    has, is_ = (np.bincount(x, t, len(hashes)).astype(np.uint32) for x in (u, w))
    return [("asked", group, own, packed(steps(hashes[at]), has[at], is_[at])) for group, at in each_group(in_groups(hashes, groups))]


def counted_pairs(pairs: DataFrame, groups: int) -> DataFrame:
    """Of each group of pairs, as parcels: its ``dishes`` of several customers, one table each for a start; what each block's
    pairs are there (``codes``: 0 as the block knows, 1 a dish of one customer, from 2 on those of several); and to the groups of
    words how many tables each has and is, at dishes of several customers (``asked``) and of one (``alone``). ``one`` and ``two``
    count dishes of so many customers.
    """

    def count(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        own, senders, lists = key[0].as_py(), found["sender"].to_numpy(), []
        for i in np.argsort(senders).tolist():
            lists.append(unpacked(found["data"][i].as_py(), "<u8", "<u4", "<u4", "<u4"))
        senders = sorted(senders.tolist())
        whole, places = united([upto(x[0]) for x in lists])
        sizes = [len(x[3]) for x in lists]
        keys, n, at = np.empty(sum(sizes), np.int64), np.concatenate([x[3] for x in lists]), 0
        for i, place in enumerate(places):
            _, u, w, _ = lists[i]
            keys[at : at + len(u)] = place[upto(u)]
            keys[at : at + len(u)] *= len(whole)
            keys[at : at + len(u)] += place[w]
            at, lists[i] = at + len(u), None
        order = np.argsort(keys)
        keys = keys[order]
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        cells, c = keys[first], np.add.reduceat(n[order], first, dtype=np.int64)
        several = np.flatnonzero(c > 1)
        several = several[np.argsort(-c[several], kind="stable")]
        code = np.zeros(len(cells), np.uint32)
        code[c == 1] = 1
        code[several] = np.arange(2, len(several) + 2, dtype=np.uint32)
        codes = np.empty(len(keys), np.uint32)
        codes[order] = np.repeat(code, np.diff(first, append=len(keys)))
        del keys, order
        codes[(codes == 1) & (n == 1)] = 0
        u, w = np.divmod(cells[several], len(whole))
        named = np.unique(np.concatenate([u, w]))
        u, w, one = np.searchsorted(named, u), np.searchsorted(named, w), np.ones(len(u), np.int64)
        out = [("dishes", own, own, packed(steps(whole[named]), u.astype(np.uint32), w.astype(np.uint32), c[several], one, 0 * one)), *asked(own, whole[named], u, w, one, groups)]
        out += [("codes", own, s, packed(part)) for s, part in zip(senders, np.split(codes, np.cumsum(sizes)[:-1]), strict=True)]
        u, w = np.divmod(cells[c == 1], len(whole))
        has, is_ = (np.bincount(x, minlength=len(whole)).astype(np.uint32) for x in (u, w))
        some = np.flatnonzero(has + is_)
        out += [("alone", group, own, packed(steps(whole[some[at]]), has[some[at]], is_[some[at]])) for group, at in each_group(in_groups(whole[some], groups))]
        sums = [pa.array([int((c == i).sum()), *[0] * (len(out) - 1)], pa.int64()) for i in (1, 2)]
        return parcels(out).append_column("one", sums[0]).append_column("two", sums[1])

    return pairs.groupBy("to").applyInArrow(count, PARCEL + ", one long, two long")


# --- sweeps


def with_alone(words: DataFrame, alone: DataFrame) -> DataFrame:
    """Of each group its words, their counts, and of dishes of one customer how many each has and is."""

    def add(key: tuple[pa.Scalar, ...], counted: pa.Table, alone: pa.Table) -> pa.Table:
        hashes, c = unpacked(counted["data"][0].as_py(), "<u8", "<i8")
        has, is_, whole = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), upto(hashes)
        for _, data in received(alone):
            some, has_some, is_some = unpacked(data, "<u8", "<u4", "<u4")
            at = np.searchsorted(whole, upto(some))
            has[at] += has_some
            is_[at] += is_some
        return pa.table([[key[0].as_py()], pa.array([packed(hashes, c, has, is_)], pa.binary())], ["to", "data"])

    return words.groupBy("to").cogroup(alone.groupBy("to")).applyInArrow(add, "to long, data binary")


def seated_words(words: DataFrame, asked: DataFrame, weight: float, discount: float, sweep: int) -> DataFrame:
    """Of each group of words: customers (tables at which a word is the dish), tables drawn for them, tables in its own restaurant;
    and who asked for which words. ``customers`` and ``tables`` are sums."""

    def draw(key: tuple[pa.Scalar, ...], counted: pa.Table, asked: pa.Table) -> pa.Table:
        own, (hashes, c, restaurant, customers) = key[0].as_py(), unpacked(counted["data"][0].as_py(), "<u8", *["<i8"] * 3)
        whole, askers, places = upto(hashes), [], []
        for sender, data in received(asked):
            some, has, is_ = unpacked(data, "<u8", "<u4", "<u4")
            at = np.searchsorted(whole, upto(some))
            restaurant[at] += has
            customers[at] += is_
            askers.append(sender)
            places.append(packed(steps(at.astype(np.uint32))))
        t = seat(customers, np.full(len(c), weight), discount, np.random.default_rng([sweep, 0, own]))
        state = packed(hashes, c, customers, t, restaurant)
        return pa.table([[own], pa.array([state], pa.binary()), pa.array([askers], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary())), [int(customers.sum())], [int(t.sum())]], ["to", "data", "askers", "places", "customers", "tables"])

    return words.groupBy("to").cogroup(asked.groupBy("to")).applyInArrow(draw, "to long, data binary, askers array<long>, places array<binary>, customers long, tables long")


class Base:
    """The restaurant of words in one sweep: the weight of new tables for one word of the base, and probabilities."""

    def __init__(self, events: float, discount: float, customers: int, tables: int):
        self.each, self.discount, self.whole = (WORD_STRENGTH + discount * tables) / events, discount, WORD_STRENGTH + customers

    def words(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.each) / self.whole


def told(state: DataFrame, base: Base) -> DataFrame:
    """To each group of pairs that asked: the words' probabilities in the restaurant of words, and tables in their own."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            _, _, customers, t, restaurant = unpacked(batch["data"][0].as_py(), "<u8", *["<i8"] * 4)
            p = base.words(customers, t).astype("<f4")
            for asker, places in zip(batch["askers"][0].as_py(), batch["places"][0].as_py(), strict=True):
                at = upto(*unpacked(places, "<u4"))
                yield from parcels([("told", asker, batch["to"][0].as_py(), packed(p[at], restaurant[at].astype(np.uint32)))]).to_batches()

    return state.select("to", "data", "askers", "places").mapInArrow(tell, PARCEL)


def seated_dishes(dishes: DataFrame, told: DataFrame, discount: float, groups: int, sweep: int) -> DataFrame:
    """The next ``dishes`` and ``asked``, with tables drawn by what groups of words ``told``; after the burn-in, also their sum."""

    def draw(key: tuple[pa.Scalar, ...], found: pa.Table, told: pa.Table) -> pa.Table:
        own, (hashes, u, w, c, _, total) = key[0].as_py(), unpacked(found["data"][0].as_py(), "<u8", "<u4", "<u4", "<i8", "<i8", "<i8")
        p, tables, answers, whole = np.zeros(len(hashes)), np.zeros(len(hashes)), dict(received(told)), upto(hashes)
        for group, at in each_group(in_groups(whole, groups)):
            p[at], tables[at] = unpacked(answers[group], "<f4", "<u4")
        t = seat(c, (CONTEXT_STRENGTH + discount * tables[u]) * p[w], discount, np.random.default_rng([sweep, 1, own]))
        return parcels([("dishes", own, own, packed(hashes, u, w, c, t, total + t * (sweep > BURN_IN))), *asked(own, whole, u, w, t, groups)])

    return dishes.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(draw, PARCEL)


# --- scores


def words_for_blocks(words: DataFrame, samples: list[tuple[DataFrame, Base]]) -> DataFrame:
    """To each block: its words' counts, and in each sample their probabilities and tables of their own."""
    bases = [base for _, base in samples]
    states = samples[0][0].select("to", F.lit(0).alias("sample"), "data")
    for i, (state, _) in enumerate(samples[1:], 1):
        states = states.unionByName(state.select("to", F.lit(i).alias("sample"), "data"))

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, states: pa.Table) -> pa.Table:
        columns = []
        for sample, data in sorted(zip(states["sample"].to_pylist(), states["data"].to_pylist(), strict=True)):
            hashes, c, customers, t, restaurant = unpacked(data, "<u8", *["<i8"] * 4)
            columns.append((bases[sample].words(customers, t).astype("<f4"), restaurant.astype(np.uint32)))
        out = []
        for block, data in received(asked):
            local, some, _ = unpacked(data, "<u4", "<u8", "<u4")
            at = np.searchsorted(upto(hashes), upto(some))
            out.append(("words", block, key[0].as_py(), packed(local, some, c[at], *(x[at] for x, _ in columns), *(x[at] for _, x in columns))))
        return parcels(out)

    return words.groupBy("to").cogroup(states.groupBy("to")).applyInArrow(answer, PARCEL)


def dishes_for_blocks(codes: DataFrame, dishes: DataFrame) -> DataFrame:
    """To each block: of its pairs in a group, in order, the customers (0: as the block knows) and the sum of sampled tables."""

    def answer(key: tuple[pa.Scalar, ...], codes: pa.Table, dishes: pa.Table) -> pa.Table:
        *_, c, _, total = unpacked(dishes["data"][0].as_py(), "<u8", "<u4", "<u4", "<i8", "<i8", "<i8")
        c, total = np.concatenate([[0, 1], c]).astype(np.uint32), np.concatenate([[0, SAMPLES], total]).astype(np.uint32)
        out = []
        for block, data in received(codes):
            (code,) = unpacked(data, "<u4")
            out.append(("dishes", block, key[0].as_py(), packed(c[code], total[code])))
        return parcels(out)

    return codes.groupBy("to").cogroup(dishes.groupBy("to")).applyInArrow(answer, PARCEL)


def scored(documents: DataFrame, answers: DataFrame, bases: list[Base], unknown: float, discount: float, groups: int, n: int, v: int) -> DataFrame:
    """Of each block its documents' rows."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def add_up(key: tuple[pa.Scalar, ...], documents: pa.Table, answers: pa.Table) -> pa.Table:
        lists = [unpacked(data, "<u4", "<u8", "<i8", *["<f4"] * SAMPLES, *["<u4"] * SAMPLES) for _, data in received(answers, "words")]
        local, hashes, c, *rest = (np.concatenate(x) for x in zip(*((x[0], upto(x[1]), *x[2:]) for x in lists), strict=True))
        order, place = np.argsort(hashes), np.empty(len(c), np.uint32)
        hashes, c, *rest = (x[order] for x in (hashes, c, *rest))
        place[local[order]] = np.arange(len(c), dtype=np.uint32)
        p = [np.where(c > 0, x.astype(float), base.each * unknown / base.whole) for x, base in zip(rest[:SAMPLES], bases, strict=True)]
        end = int(np.searchsorted(hashes, word_hashes([END])[0]))
        parts = [(d, f, n.astype(np.int64), place[ids]) for d, f, n, ids in (unpacked(data, "<i8", "u1", "<u4", "<u4") for _, data in received(documents))]
        pairs, seen = distinct_pairs([(ids, lengths, flags % 2 == 1) for _, flags, lengths, ids in parts], len(c), end)
        context, dish = (x.astype(np.uint32) for x in np.divmod(pairs, len(c)))
        # dishes that no other block knows have one customer and one table
        customers = (seen > 0).astype(np.uint32)
        tables, of = SAMPLES * customers, dict(received(answers, "dishes"))
        for group, own in each_group(pair_groups(hashes[context], hashes[dish], groups)):
            found, total = unpacked(of[group], "<u4", "<u4")
            customers[own], tables[own] = np.where(found, found, customers[own]), np.where(found, total, tables[own])
        model = customers - discount / SAMPLES * tables
        for q, restaurant in zip(p, rest[SAMPLES:], strict=True):
            model += (CONTEXT_STRENGTH + discount * restaurant)[context] * q[dish] / SAMPLES
        model = np.log10(model / (CONTEXT_STRENGTH + c)[context])
        base, out = np.log10((c + 1) / (n + 1 * (v + 1))), []
        for doc_ids, flags, lengths, ids in parts:
            own, which = np.unique(pairs_of(ids, lengths, len(c), end), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64)[ids], base[ids], model[np.searchsorted(pairs, own)][which])]
            out.append(pa.table([pa.array(doc_ids, pa.int64(), mask=flags > 1), pa.array(flags % 2 == 1), pa.array(lengths), sums[0], np.full(len(flags), n, np.int64), *sums[1:]], names))
        return pa.concat_tables(out)

    return documents.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(add_up, SCHEMA)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the add-one unigram score, and the model's log10 probability."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.length(text_column())).alias("chars")).first()
    if not size["rows"]:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    groups = -(-size["chars"] // GROUP_CHARS) or 1
    blocks = materialize_kinds(encode(docs, groups), "blocks", ("documents", "words", "pairs"))
    words = materialize(counted_words(blocks["words"]), "words")
    n, v, twice, thrice = words.agg(*(F.sum(x) for x in ("n", "v", "twice", "thrice"))).first()
    once = v - twice
    unseen = max(1.0, once * once / (2 * (twice - thrice)) if twice > thrice else once * (once - 1) / 2)
    whole = v + unseen
    word_discount = discount_of(once, twice - thrice)

    pairs = materialize_kinds(counted_pairs(blocks["pairs"], groups), "pairs", ("dishes", "codes", "asked", "alone"))
    drop_table(blocks["pairs"])
    ones, twos = pairs["dishes"].agg(F.sum("one"), F.sum("two")).first()
    discount = discount_of(ones, twos)
    dishes, asked_ = (pairs[k].drop("one", "two") for k in ("dishes", "asked"))
    words = materialize(with_alone(words, pairs["alone"]), "words")
    tables, samples = v, []
    for sweep in range(SWEEPS + 1):
        weight = (WORD_STRENGTH + word_discount * tables) / whole
        state = materialize(seated_words(words, asked_, weight, word_discount, sweep), "seated")
        customers, tables = state.agg(F.sum("customers"), F.sum("tables")).first()
        base = Base(whole, word_discount, customers, tables)
        if sweep > BURN_IN:
            samples.append((state, base))
        if sweep < SWEEPS:
            following = materialize_kinds(seated_dishes(dishes, told(state, base), discount, groups, sweep + 1), "dishes", ("dishes", "asked"))
            for over in (dishes, asked_, *(() if sweep > BURN_IN else (state,))):
                drop_table(over)
            dishes, asked_ = following["dishes"], following["asked"]
    answers = words_for_blocks(blocks["words"], samples).unionByName(dishes_for_blocks(pairs["codes"], dishes))
    return scored(blocks["documents"], answers, [base for _, base in samples], unseen, discount, groups, n, v)


def discount_of(once: int, twice: int) -> float:
    """The discount that so many dishes of one and of two customers suggest."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pitman_yor_scores": op4_pitman_yor_scores}
ORACLE_SQL: dict[str, str] = {}
