"""Removal of bytes that lie in a string of 200 bytes which also starts elsewhere, by a hash-compared suffix sort.

Strings of ``LENGTH`` bytes (windows) are not all sorted: a window's *anchor* is the ``GRAM`` bytes within it of the least hash,
so the anchor follows from the window alone, and equal windows have equal anchors at equal places. About one byte in seventy
is an anchor, and an anchor stands for a run of neighbouring windows, whose bytes are its context.

1. Anchors whose bytes occur once in the corpus go; the others meet by the hash of these bytes.
2. Equal contexts are counted. Where there are two, all their windows are repeated.
3. Different contexts of one anchor are cut out of their texts and sorted, by what follows the anchor's start and by what
   precedes it: a mergesort whose comparisons find the common extension by binary search over polynomial prefix hashes.
   Neighbours' common extensions are verified byte by byte (if a hash has failed, the sort is done again with other numbers).
   Both orders part the contexts into classes of equal extensions of any length, which tell the windows that two share.
   An anchor of very many different contexts is not sorted in one task: its windows are counted by their hashes.
4. The repeated windows of a text are joined to it, and the bytes that they cover removed.

Contexts are told by 128 bits (of anchor and context), windows of the very frequent anchors and texts by 128 bits, too.

Null text counts as empty; a text shorter than a window loses nothing; a text that occurs twice loses all, if it is long
enough. Equal or null ids and repeated rows are kept as rows of their own. Long texts are read by stretches. Only
``doc_id`` and ``text`` are read (further columns may have any name); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, materialize_kinds, table, text_column

LENGTH, GRAM = 200, 64
#: Windows of one anchor: it starts at most so many bytes after the window.
REACH = LENGTH - GRAM
#: Bytes that a task hashes at once; texts are put together or cut to that.
STRETCH = 1 << 20
#: Contexts sorted at once; anchors of more than ``HOT`` different contexts are counted instead.
SORTED, HOT = 8192, 16384
PLACES = "kind string, kh long, ch long, d1 long, d2 long, start long, stop long, ahead int, n long"


# --- polynomial prefix hashes


@functools.lru_cache(maxsize=4)
def _numbers(size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for the bytes, and the powers of a random odd base and of its inverse, all modulo 2^64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    of_byte, base = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(0, 1 << 63)) * 2 + 1
    steps = [np.full(size + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return of_byte, *(np.multiply.accumulate(s) for s in steps)


class Hashes:
    """Hashes of any substrings of ``data``, each by two look-ups."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        size = max(STRETCH + LENGTH, 1 << (len(data)).bit_length())
        of_byte, powers, self.back = _numbers(size, seed)
        self.before = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of_byte[data] * powers[: len(data)], out=self.before[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.before[start + length] - self.before[start]) * self.back[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.before) - length
        return (self.before[length:] - self.before[:n]) * self.back[:n]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# --- anchors


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` numbers the place of its least one, the first of equal ones."""
    n, blocks = len(h) - width + 1, -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid, place = padded.reshape(blocks, width), np.arange(blocks * width).reshape(blocks, width)
    behind = np.minimum.accumulate(grid, 1)
    fresh = np.ones_like(grid, bool)
    fresh[:, 1:] = grid[:, 1:] < behind[:, :-1]
    behind_at = np.maximum.accumulate(np.where(fresh, place, -1), 1).ravel()
    ahead = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]
    fresh = np.ones_like(grid, bool)
    fresh[:, :-1] = grid[:, :-1] <= ahead[:, 1:]
    ahead_at = np.minimum.accumulate(np.where(fresh, place, blocks * width)[:, ::-1], 1)[:, ::-1].ravel()
    i = np.arange(n)
    return np.where(ahead.ravel()[i] <= behind.ravel()[i + width - 1], ahead_at[i], behind_at[i + width - 1])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of windows; ``ends`` are those of the texts in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    hashes = Hashes(data).all(GRAM)
    at = least_places(spread(hashes), REACH + 1)
    window = np.arange(len(at))
    own = np.searchsorted(ends, window, "right")
    whole = window + LENGTH <= ends[np.minimum(own, len(ends) - 1)]
    begins = whole.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    stops = whole.copy()
    stops[:-1] &= (at[1:] != at[:-1]) | ~whole[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return first, last, at[first], hashes[at[first]]


def digest(text: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(text)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted and joined where they touch or overlap."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    return start[new], np.append(stop[:-1][new[1:]], stop[-1:])


def _found(parts: list[tuple[tuple[int, int], int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Anchors of stretches of texts (digest, offset, bytes). Contexts that recur within the stretches of one text are one row, with their spans."""
    joined = b"".join(p[2] for p in parts)
    data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(p[2]) for p in parts])
    first, last, at, kh = anchors(data, ends)
    if not len(first):
        return
    stop, view = last + LENGTH, memoryview(joined)
    ahead = at - first
    ch = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], o) for a, b, o in zip(first.tolist(), stop.tolist(), ahead.tolist(), strict=True)), np.uint64, len(first))
    own = np.searchsorted(ends, first, "right")
    shift = np.array([p[1] for p in parts], np.int64) - (ends - [len(p[2]) for p in parts])
    d1, d2 = (np.array([p[0][i] for p in parts], np.int64) for i in (0, 1))
    _, kept, same, n = np.unique(np.stack([own.astype(np.uint64), kh, ch]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    start, stop = first + shift[own], stop + shift[own]
    whole = (kh[kept].view(np.int64), ch[kept].view(np.int64), d1[own[kept]], d2[own[kept]], start[kept], stop[kept], ahead[kept], n)
    yield _rows("anchor", *whole)
    twice = np.flatnonzero(n[same.ravel()] > 1)
    for text in np.unique(own[twice]).tolist():
        mine = twice[own[twice] == text]
        a, b = merged(start[mine], stop[mine])
        zero = np.zeros(len(a), np.int64)
        yield _rows("span", zero, zero, zero + d1[text], zero + d2[text], a, b, zero, zero)


def _rows(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [f.split()[0] for f in PLACES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.string()), *(pa.array(c, pa.int32() if i == 6 else pa.int64()) for i, c in enumerate(columns))], names)


def places(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: ``anchor``, a context with its text and place; ``span``, bytes known to be repeated, as the text has them twice or a copy of it was read."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, {}
        for batch in batches:
            for text in batch["text"]:
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < LENGTH:
                    continue
                key = digest(data)
                seen[key] = seen.get(key, 0) + 1
                if seen[key] > 1:  # its anchors are out already; a copy says that all of it is repeated
                    if seen[key] == 2:
                        yield _rows("span", *(np.array([x]) for x in (0, 0, *key, 0, len(data), 0, 0)))
                    continue
                for offset in range(0, len(data) - LENGTH + 1, STRETCH - LENGTH + 1):
                    held.append((key, offset, data[offset : offset + STRETCH]))
                    size += len(held[-1][2])
                    if size >= STRETCH:
                        yield from _found(held)
                        held, size = [], 0
        if held:
            yield from _found(held)

    return docs.select(text_column().alias("text")).mapInArrow(find, PLACES)


# --- the suffix sort


class Suffixes:
    """Byte strings in groups, sorted within each group; ``lcp[i]`` is what the i-th in order shares with the one before, 0 at a group's first."""

    def __init__(self, texts: list[bytes], group: np.ndarray) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.group, seed = group, 1
        while True:
            self.hashes = Hashes(self.data, seed)
            self.order = self._sorted()
            self.lcp = np.zeros(len(texts), np.int64)
            if len(texts) > 1:
                a, b = self.order[:-1], self.order[1:]
                together = group[a] == group[b]
                self.lcp[1:][together] = self.common(a[together], b[together])
            if self._verified():
                return
            seed += 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of strings a and b, by binary search over the hashes of beginnings."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        x, y = self.start[a], self.start[b]
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hashes.of(x, middle) == self.hashes.of(y, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def _before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether string a comes before b; where they are equal, ``ties``."""
        n = self.common(a, b)
        over = n >= np.minimum(self.length[a], self.length[b])
        last = max(len(self.data) - 1, 0)
        x, y = (self.data[np.minimum(self.start[s] + n, last)] if len(self.data) else n for s in (a, b))
        return np.where(over, np.where(self.length[a] == self.length[b], ties, self.length[a] < self.length[b]), x < y)

    def _sorted(self) -> np.ndarray:
        """All groups by one bottom-up mergesort: each string looks for its place among those of the neighbouring run."""
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        first = np.flatnonzero(np.diff(g, prepend=g[0] - 1 if len(g) else 0))
        size = np.diff(np.append(first, len(g)))
        base, top = np.repeat(first, size), np.repeat(first + size, size)
        width, spot = 1, np.arange(len(g))
        while width < size.max(initial=0):
            run = (spot - base) // width
            left = run % 2 == 0
            low = np.minimum(base + np.where(left, run + 1, run - 1) * width, top)
            high = np.minimum(low + width, top)
            begin = low.copy()
            while len(live := np.flatnonzero(low < high)):
                middle = (low[live] + high[live]) // 2
                # Of equal strings, those of the left run come first.
                less = self._before(order[middle], order[live], ~left[live])
                low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]
            moved = np.empty_like(order)
            moved[base + run // 2 * 2 * width + (spot - base) % width + low - begin] = order
            order, width = moved, 2 * width
        return order

    def _verified(self) -> bool:
        """Whether neighbours share just the bytes that the hashes say, and are in order."""
        for at in range(1, len(self.order), SORTED):
            i = np.arange(at, min(at + SORTED, len(self.order)))
            i = i[self.group[self.order[i]] == self.group[self.order[i - 1]]]
            if not len(i):
                continue
            a, b = self.order[i - 1], self.order[i]
            column = np.arange(int(min(self.length[a].max(), self.length[b].max())))
            inside = column < np.minimum(self.length[a], self.length[b])[:, None]
            last = max(len(self.data) - 1, 0)
            differs = inside & (self.data[np.minimum(self.start[a][:, None] + column, last)] != self.data[np.minimum(self.start[b][:, None] + column, last)]) if len(column) else inside
            shared = np.where(differs.any(1), differs.argmax(1), np.minimum(self.length[a], self.length[b])) if len(column) else np.zeros(len(i), np.int64)
            if (shared != self.lcp[i]).any():
                return False
        return True

    def classes(self, length: int) -> np.ndarray:
        """A number for each string: equal for those of one group that share the first ``length`` bytes, if both have so many."""
        g = self.group[self.order]
        new = self.lcp < length
        new[1:] |= g[1:] != g[:-1]
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(new)
        return out


def shared_windows(group: np.ndarray, contexts: list[bytes], ahead: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context the spans of bytes in windows that another context of its group has at the same distance from the anchor."""
    length = np.array([len(c) for c in contexts], np.int64)
    right = Suffixes([c[a:] for c, a in zip(contexts, ahead.tolist(), strict=True)], group)
    left = Suffixes([c[:a][::-1] for c, a in zip(contexts, ahead.tolist(), strict=True)], group)
    found = np.zeros((len(contexts), REACH + 1), bool)
    for o in range(REACH + 1):
        able = np.flatnonzero((ahead >= o) & (length - ahead >= LENGTH - o))
        if len(able) > 1:
            pair = right.classes(LENGTH - o)[able] * (len(contexts) + 2) + left.classes(o)[able]
            _, same, n = np.unique(pair, return_inverse=True, return_counts=True)
            found[able[n[same.ravel()] > 1], o] = True
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for i in np.flatnonzero(found.any(1)).tolist():
        first = ahead[i] - np.flatnonzero(found[i])[::-1]
        out[i] = list(zip(*(x.tolist() for x in merged(first, first + LENGTH)), strict=True))
    return out


SHARED = "kh long, ch long, start long, stop long"


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """(kh, ch, start, stop) of ``contexts(kh, ch, ahead, context)``: spans, from the context's start, that other contexts of ``kh`` share."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solved(t: pa.Table) -> pa.RecordBatch:
            spans = shared_windows(t["kh"].to_numpy(), t["context"].to_pylist(), t["ahead"].to_numpy().astype(np.int64))
            row = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[row]) for c in ("kh", "ch")] + [pa.array(flat[:, 0]), pa.array(flat[:, 1])], ("kh", "ch", "start", "stop"))

        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            if held.num_rows >= SORTED:
                kh = held["kh"].to_numpy()
                cut = int(np.searchsorted(kh, kh[-1]))  # the last anchor may go on in the next batch
                if cut:
                    yield solved(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    columns = contexts.select("kh", "ch", "ahead", "context")
    return columns.repartition("kh").sortWithinPartitions("kh").mapInArrow(sort, SHARED)


def count_windows(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts: windows are counted by their hashes, without meeting in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kh, ch, context in zip(*(batch[c].to_pylist() for c in ("kh", "ch", "context")), strict=True):
                w = [digest(context[i : i + LENGTH]) for i in range(len(context) - LENGTH + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([kh] * len(w)), pa.array([ch] * len(w)), pa.array(range(len(w)), pa.int64()), *(pa.array([x[i] for x in w]) for i in (0, 1))], ("kh", "ch", "start", "w1", "w2"))

    windows = contexts.select("kh", "ch", "context").mapInArrow(cut, "kh long, ch long, start long, w1 long, w2 long")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    return windows.join(often, ["w1", "w2"]).select("kh", "ch", "start", (F.col("start") + LENGTH).alias("stop"))


# --- the operator


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with (d1, d2), its text's digest."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest(t.as_buffer().to_pybytes()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], [*batch.schema.names, "d1", "d2"])

    plain = docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).select(*columns)
    return plain.mapInArrow(key, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + ["d1 long", "d2 long"]))


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(kh, ch, ahead, d1, d2, start, stop)`` with the ``context``, read from the texts."""
    asked = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("kh", "ch", "ahead", "start", "stop")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch["text"], batch["asked"], strict=True):
                data, rows = text.as_buffer(), asked.values
                start, stop = (rows.field(f).to_numpy() for f in ("start", "stop"))
                contexts = [data[a:b].to_pybytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.field("kh"), rows.field("ch"), rows.field("ahead"), pa.array(contexts, pa.binary())], ("kh", "ch", "ahead", "context"))

    found = keyed(docs, "text").join(asked, ["d1", "d2"]).select("text", "asked").mapInArrow(cut, "kh long, ch long, ahead int, context binary")
    return found.groupBy("kh", "ch").agg(F.first("ahead").alias("ahead"), F.first("context").alias("context"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(d1, d2, spans): for the texts of these digests the spans of repeated bytes, which may overlap."""
    found = materialize_kinds(places(docs), "places", ("anchor", "span"))
    own = found["anchor"].drop("kind")
    often = own.groupBy("kh").agg(F.sum("n").alias("total")).filter("total > 1").select("kh")
    near = materialize(own.join(often, "kh"), "anchors")
    contexts = materialize(near.groupBy("kh", "ch").agg(F.sum("n").alias("n"), F.min_by(F.struct("d1", "d2", "start", "stop", "ahead"), F.struct("d1", "d2", "start")).alias("first")), "contexts")
    kinds = contexts.groupBy("kh").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = materialize(contexts.join(kinds, "kh").select("kh", "ch", "n", "kinds", "first.*"), "mixed")
    texts = materialize(cut_contexts(docs, mixed).join(kinds, "kh"), "texts")
    shared = sort_contexts(texts.filter(F.col("kinds") <= hot)).unionByName(count_windows(texts.filter(F.col("kinds") > hot)))
    # Contexts that occur once have one place; of the others all places are wanted, and all their bytes.
    once = mixed.filter("n = 1").select("kh", "ch", "d1", "d2", F.col("start").alias("base")).join(shared, ["kh", "ch"]).select("d1", "d2", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("stop")).alias("stop"))
    full = near.join(contexts.filter("n > 1").select("kh", "ch"), ["kh", "ch"]).select("d1", "d2", "start", "stop")
    spans = found["span"].select("d1", "d2", "start", "stop").unionByName(once).unionByName(full)
    return spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, starts, stops): what is left of every text, as bytes, and the maximal runs that were removed."""
    spans = materialize(repeated_spans(docs, hot), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                data, own = text.as_buffer().to_pybytes(), batch["spans"][i].values
                none = np.zeros(0, np.int64)
                a, b = merged(own.field("start").to_numpy(), own.field("stop").to_numpy()) if own is not None else (none, none)
                keep = [*zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
                kept = b"".join(data[x:y] for x, y in keep)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), pa.array([len(data)], pa.int64()), pa.array([kept], pa.binary()), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64()))], ("doc_id", "n_bytes", "kept", "starts", "stops"))

    joined = keyed(docs, "doc_id", "text").join(spans, ["d1", "d2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, starts array<long>, stops array<long>")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
