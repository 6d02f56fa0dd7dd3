"""The trie of conversations' prefixes, by z-fast tries.

A conversation is a sequence of turns. Turns are told by 120 bits of a digest of role and text, prefixes by a polynomial hash
of their turns' digests (four lanes modulo primes of 31 bits). A task takes a stretch of conversations into a *z-fast trie*:
its nodes are compacted, each stands for an edge of depths (parent, extent], and the table of handles holds it under the
prefix at the two-fattest depth of that range, the one with the most trailing zero bits. A conversation's place is found by fat
binary search over depths: a handle that is there moves the search to its node's extent, one that is not moves it above.
Conversations are located and inserted in batches, and edges are expanded to a row a depth. Tasks' rows are summed by prefix,
so that a first turn which all conversations share is one row a task.

Sums over subtrees need no walk over levels. A node belongs to its least member, whose nodes are then the lower end of its
own path. A sum over a subtree is the sum over the node's members of all that belongs to each, less what belongs to its
owner above it; the same tries add that up. Conversations are cut into stretches of ``SEGMENT`` turns, each with
the hash of what precedes it, and positions are found by a sort over ranges, so that no conversation need fit in a task.

The digests of turns, depths and parents of all rows of a prefix are compared: should two prefixes ever share a hash, the job fails.

Rows are in order of turn (null first), then role, then text; null role or text is empty. Rows without ``conv_id`` are no
conversation's. Repeated rows are turns of their own. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read (further columns
may have any name); an empty table gives an empty result, as a root without members is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import materialize, table, text_column

SEGMENT = 4096
#: Turns that a task holds in one trie, and sequences located before they are inserted.
HELD, BATCH = 1 << 17, 1024
#: Ids hashed together before they meet at their node.
CHUNK = 4096
#: A node with one of so many of all children is a hub; there are at most so many.
HUBS = 500
#: The largest primes below 2^31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([1103515245, 1664525000, 69069069, 1812433253], np.int64)

TURNS = "conv_id long, part int, head boolean, nth long, a long, b long, n long"


# --- turns and their positions


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, n): a row a turn, with its position from 1, its digest and the UTF-8 bytes of its text.

    Rows are sorted over ranges of (conversation, turn), so one conversation may lie in many partitions; what a partition's first
    conversation has in those before is added from one row a partition.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, count, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            conv = batch["conv_id"].to_pylist()
            nth, heads, a, b, n = [], [], [], [], []
            for c, role, text in zip(conv, batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if c != current:
                    head, current, count = current is None, c, 0
                role, text = role.encode(), text.encode()
                d = hashlib.md5(b"%d:" % len(role) + role + text, usedforsecurity=False).digest()
                nth.append(count)
                heads.append(head)
                a.append(int.from_bytes(d[:8], "big") >> 4)
                b.append(int.from_bytes(d[8:], "big") >> 4)
                n.append(len(text))
                count += 1
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array([part] * len(conv), pa.int32()), pa.array(heads), *(pa.array(x, pa.int64()) for x in (nth, a, b, n))], [f.split()[0] for f in TURNS.split(", ")])

    plain = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_column("role").alias("role"), text_column("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    keys = ("conv_id", "turn", "role", "text", "row")
    turns = materialize(plain.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(digested, TURNS), "turns")
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("nth", F.struct("conv_id", "nth")).alias("nth"))
    offsets, before, n = [], None, 0
    for r in sorted(ends.collect()):
        offset = n if r["first"] == before else 0
        offsets.append((r["part"], offset))
        before, n = r["last"], r["nth"] + 1 + (offset if r["first"] == r["last"] else 0)
    shift = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, offset long"))
    pos = F.col("nth") + 1 + F.when(F.col("head"), F.col("offset")).otherwise(0)
    return turns.join(shift, "part").select("conv_id", pos.alias("pos"), "a", "b", "n")


def segments(turns: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, turns, depth, state): stretches of conversations, with the depth and the hash of what precedes them.

    ``turns(conv_id, pos, a, b, n)``: positions are in order, but may leave out numbers; a row of position 0 is no turn, it only
    names a conversation, and gives a stretch only where there are no turns.
    """
    seg = (F.greatest(F.col("pos") - 1, F.lit(0)) / length).cast("long")
    listed = turns.groupBy("conv_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("turns"))
    cut = materialize(listed.withColumn("turns", F.filter("turns", lambda t: t["pos"] > 0)), "segments")
    long = cut.join(cut.filter("seg > 0").select("conv_id").distinct(), "conv_id", "left_semi")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [prefix_lanes(*_digests(t))[-1] for t in batch["turns"]]
            size = [len(t) for t in batch["turns"]]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["seg"], pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ("conv_id", "seg", "size", "lanes"))

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("seg")
        depth, state, out = 0, np.zeros(4, np.int64), []
        for size, lanes in zip(group["size"].to_pylist(), group["lanes"].to_pylist(), strict=True):
            out.append((depth, state))
            state, depth = (state + np.array(lanes) * _power(depth)) % PRIMES, depth + size
        return pa.table({"conv_id": group["conv_id"], "seg": group["seg"], "depth": pa.array([d for d, _ in out], pa.int64()), "state": pa.array([s for _, s in out], pa.list_(pa.int64()))})

    starts = long.mapInArrow(sums, "conv_id long, seg long, size long, lanes array<long>").groupBy("conv_id").applyInArrow(follow, "conv_id long, seg long, depth long, state array<long>")
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    # An empty stretch before others would be a second one at the root.
    return cut.join(starts, ["conv_id", "seg"], "left").filter(F.col("depth").isNull() | (F.size("turns") > 0)).select("conv_id", "seg", "turns", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("state", zero).alias("state"))


def _digests(turns: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = turns.values
    return rows.field("a").to_numpy(), rows.field("b").to_numpy()


def _power(n: int) -> np.ndarray:
    return np.array([pow(int(b), n, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.int64)


_powers: list[np.ndarray] = []


def prefix_lanes(a: np.ndarray, b: np.ndarray, depth: int = 0, state: np.ndarray | None = None) -> np.ndarray:
    """The hash lanes of all prefixes of a stretch of turns, the first of which is what precedes it: of length n + 1."""
    if not _powers or len(_powers[0]) < len(a):
        size = max(SEGMENT, len(a))
        rows = np.ones((size, 4), np.int64)
        for i in range(1, size):
            rows[i] = rows[i - 1] * BASES % PRIMES
        _powers[:] = [rows]
    x = np.stack([a, a, b, b], 1) % PRIMES + 1
    steps = x * _powers[0][: len(a)] % PRIMES * _power(depth) % PRIMES
    out = np.zeros((len(a) + 1, 4), np.int64) if state is None else np.repeat(np.asarray(state, np.int64)[None], len(a) + 1, 0)
    out[1:] += np.cumsum(steps, 0)
    return out % PRIMES


def prefix_keys(lanes: np.ndarray) -> np.ndarray:
    """Two numbers a prefix."""
    return np.stack([lanes[:, 0] << 31 | lanes[:, 1], lanes[:, 2] << 31 | lanes[:, 3]], 1)


# --- the z-fast trie


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with the most trailing zero bits."""
    return high & -1 << (low ^ high).bit_length() - 1


class Sequence:
    """Turns from depth ``first`` on; ``key(d)`` names the prefix of depth d."""

    def __init__(self, first: int, keys: np.ndarray) -> None:
        self.first, self.last, self.table, self.bytes = first, first + len(keys) - 1, keys, keys.tobytes()

    def key(self, depth: int) -> bytes:
        at = 16 * (depth - self.first)
        return self.bytes[at : at + 16]


class ZFastTrie:
    """Compacted nodes of sequences, which may begin at any prefix; each prefix that one begins at is a root."""

    def __init__(self, width: int) -> None:
        self.handles: dict[bytes, int] = {}
        self.names: dict[bytes, int] = {}  # of the first prefix of each edge
        self.roots: dict[bytes, int] = {}
        self.extent: list[int] = []
        self.above: list[int] = []  # the parent's extent
        self.parent: list[int] = []
        self.example: list[int] = []  # a sequence through the node
        self.weights: list[list[int]] = []
        self.least: list[int | None] = []
        self.sequences: list[Sequence] = []
        self.width = width

    def _node(self, parent: int, above: int, extent: int, example: int) -> int:
        self.parent.append(parent)
        self.above.append(above)
        self.extent.append(extent)
        self.example.append(example)
        self.weights.append([0] * self.width)
        self.least.append(None)
        return len(self.extent) - 1

    def _key(self, node: int, depth: int) -> bytes:
        return self.sequences[self.example[node]].key(depth)

    def _enter(self, node: int) -> None:
        """Put a node into the table of handles and under its name."""
        self.handles[self._key(node, two_fattest(self.above[node], self.extent[node]))] = node
        self.names[self._key(node, self.above[node] + 1)] = node

    def root(self, s: int) -> int:
        q = self.sequences[s]
        if q.key(q.first) not in self.roots:
            self.roots[q.key(q.first)] = self._node(-1, q.first, q.first, s)
        return self.roots[q.key(q.first)]

    def locate(self, s: int, node: int) -> int:
        """The deepest node below ``node`` whose whole extent is a prefix of sequence s, by fat binary search."""
        q, low, high = self.sequences[s], self.extent[node], self.sequences[s].last
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(q.key(middle))
            if found is None or self.extent[found] > q.last or q.key(self.extent[found]) != self._key(found, self.extent[found]):
                high = middle - 1
            else:
                node, low = found, self.extent[found]
        return node

    def insert(self, s: int, node: int) -> int:
        """The node at which sequence s ends, made where there is none; ``node`` is one that it is known to pass."""
        q, node = self.sequences[s], self.locate(s, node)
        if q.last == self.extent[node]:
            return node
        leaving = self.names.get(q.key(self.extent[node] + 1))
        if leaving is None:
            new = self._node(node, self.extent[node], q.last, s)
            self._enter(new)
            return new
        # The sequence leaves this edge: the common part is found by binary search over prefixes.
        low, high = self.above[leaving] + 1, min(self.extent[leaving] - 1, q.last)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if q.key(middle) == self._key(leaving, middle) else (low, middle - 1)
        del self.handles[self._key(leaving, two_fattest(self.above[leaving], self.extent[leaving]))]
        fork = self._node(node, self.above[leaving], low, self.example[leaving])
        self.parent[leaving], self.above[leaving] = fork, low
        self._enter(fork)
        self._enter(leaving)
        if q.last == low:
            return fork
        new = self._node(fork, low, q.last, s)
        self._enter(new)
        return new

    def add(self, batch: list[tuple[Sequence, int, list[int]]]) -> None:
        """Insert sequences, each with an id and weights: all are located first, and then inserted from where they were."""
        first = len(self.sequences)
        self.sequences += [s for s, _, _ in batch]
        places = [self.locate(first + i, self.root(first + i)) for i in range(len(batch))]
        for i, (_, conv, weights) in enumerate(batch):
            end = self.insert(first + i, places[i])
            self.weights[end] = [x + y for x, y in zip(self.weights[end], weights, strict=True)]
            self.least[end] = conv if self.least[end] is None else min(conv, self.least[end])

    def expanded(self) -> Iterator[tuple[int, int, int, int | None, list[int]]]:
        """(sequence, depth from, depth to, least id, summed weights) of each edge; that of a root is its own depth."""
        for node in sorted(range(len(self.extent)), key=self.extent.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                self.weights[up] = [x + y for x, y in zip(self.weights[up], self.weights[node], strict=True)]
                self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])
            yield self.example[node], self.above[node] + (up >= 0), self.extent[node], self.least[node], self.weights[node]


def fold(cut: DataFrame, *weights: str) -> DataFrame:
    """(k1, k2, depth, g1, g2, n, conv_id, sums): each prefix with its parent's key, its last text's bytes, least member and summed weights.

    ``cut`` is of :func:`segments` with columns of ``weights``. The root alone has no parent.
    """
    width = len(weights)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, waiting, turns = ZFastTrie(width), 0, [], []

        def done() -> Iterator[pa.RecordBatch]:
            trie.add(waiting)
            columns: list[list] = [[] for _ in range(10)]
            for s, low, high, least, sums in trie.expanded():
                q, (a, b, n) = trie.sequences[s], turns[s]
                if low == 0:
                    for c, x in zip(columns, ([0], [0], [0], [None], [None], [0], [0], [0], [least], [sums]), strict=True):
                        c += x
                    continue
                if low == q.first:
                    continue  # a root within a conversation is the end of the stretch before
                at = slice(low - q.first, high - q.first + 1)
                up = slice(low - q.first - 1, high - q.first)
                size = high - low + 1
                found = (q.table[at, 0], q.table[at, 1], range(low, high + 1), q.table[up, 0], q.table[up, 1], a[up], b[up], n[up], [least] * size, [sums] * size)
                for c, x in zip(columns, found, strict=True):
                    c += x.tolist() if isinstance(x, np.ndarray) else x
            types = [pa.int64()] * 9 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ("k1", "k2", "depth", "g1", "g2", "a", "b", "n", "conv_id", "sums"))

        for batch in batches:
            for conv, row, depth, state, *w in zip(batch["conv_id"].to_pylist(), batch["turns"], batch["depth"].to_pylist(), batch["state"].to_pylist(), *(batch[x].to_pylist() for x in weights), strict=True):
                a, b = _digests(row)
                turns.append((a, b, row.values.field("n").to_numpy()))
                waiting.append((Sequence(depth, prefix_keys(prefix_lanes(a, b, depth, np.array(state)))), conv, w))
                held += len(a) + 1
                if len(waiting) == BATCH:
                    trie.add(waiting)
                    waiting.clear()
                if held >= HELD:
                    yield from done()
                    trie, held, waiting, turns = ZFastTrie(width), 0, [], []
        if turns:
            yield from done()

    rows = cut.select("conv_id", "turns", "depth", "state", *(F.col(w).cast("long").alias(w) for w in weights)).mapInArrow(tries, "k1 long, k2 long, depth long, g1 long, g2 long, a long, b long, n long, conv_id long, sums array<long>")
    sums = [F.sum(F.col("sums")[i]).alias(w) for i, w in enumerate(weights)]
    known = F.struct("depth", "g1", "g2", "a", "b", "n")
    found = rows.groupBy("k1", "k2").agg(F.min(known).alias("known"), F.max(known).alias("other"), F.min("conv_id").alias("conv_id"), *sums)
    sure = F.when(F.col("known") == F.col("other"), F.col("known")).otherwise(F.raise_error(F.lit("two prefixes share a hash")).cast("struct<depth:bigint,g1:bigint,g2:bigint,a:bigint,b:bigint,n:bigint>"))
    return found.withColumn("known", sure).select("k1", "k2", "known.depth", "known.g1", "known.g2", "known.n", "conv_id", *weights)


def end_keys(cut: DataFrame) -> DataFrame:
    """(conv_id, k1, k2): the prefix that is the whole conversation."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [prefix_keys(prefix_lanes(*_digests(t), d, np.array(s)))[-1] for t, d, s in zip(batch["turns"], batch["depth"].to_pylist(), batch["state"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["seg"], *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], ("conv_id", "seg", "k1", "k2"))

    found = cut.select("conv_id", "seg", "turns", "depth", "state").mapInArrow(last, "conv_id long, seg long, k1 long, k2 long")
    return found.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "seg").alias("k")).select("conv_id", "k.*")


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ids that end at a node, in order, joined by commas.

    A digest takes its bytes one after the other, so a node's ids meet in one task, but as ready strings of neighbouring ids,
    which are read in order and never held together.
    """
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = ends.groupBy("k1", "k2", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        schema = ("k1", "k2", "ends_sha256")
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], schema)

    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").select("k1", "k2", "ids").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _parents(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(k1, k2, parent_conv_id) of ``tops(k1, k2, g1, g2)``. Nodes with a large part of all children are few, and broadcast."""
    total = nodes.count()
    inner = nodes.filter("n_children > 0").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("conv_id").alias("up"), "n_children")
    hubs = inner.filter(F.col("n_children") * HUBS >= total).select("g1", "g2", F.col("up").alias("hub"))
    marked = tops.join(F.broadcast(hubs), ["g1", "g2"], "left")
    others = marked.filter("hub IS NULL").join(inner, ["g1", "g2"]).select("k1", "k2", F.col("up").alias("parent_conv_id"))
    return others.unionByName(marked.filter("hub IS NOT NULL").select("k1", "k2", F.col("hub").alias("parent_conv_id")))


def prefix_trie(turns: DataFrame, length: int = SEGMENT) -> DataFrame:
    """A row a node of the trie of ``turns(conv_id, pos, a, b, n)``: the first ``depth`` turns of its least member ``conv_id``."""
    cut = materialize(segments(turns, length), "cut")
    # A conversation counts at every node it passes, whichever stretch that is in.
    found = materialize(fold(cut.withColumn("n_convs", F.lit(1)), "n_convs"), "prefixes")
    below = found.filter("depth > 0").groupBy(F.col("g1").alias("k1"), F.col("g2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = found.join(below, ["k1", "k2"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("n")})
    block = (F.col("depth") / length).cast("long")
    path = Window.partitionBy("conv_id", "block").orderBy("depth")
    placed = nodes.withColumn("block", block).withColumn("over", F.coalesce(F.sum("saved").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).withColumn("top", F.row_number().over(path) == 1)
    placed = materialize(placed, "nodes")
    blocks = placed.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"))
    long = blocks.join(blocks.filter("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    before = long.select("conv_id", "block", F.sum("saved").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    owned = placed.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")).filter("saved <> 0 OR leaf <> 0")
    sums = fold(cut.join(owned, "conv_id"), "saved", "leaf").select("k1", "k2", F.col("saved").alias("all_saved"), F.col("leaf").alias("n_leaves"))
    parents = _parents(placed, placed.filter("top AND depth > 0").select("k1", "k2", "g1", "g2"))
    out = placed.join(before, ["conv_id", "block"], "left").join(sums, ["k1", "k2"], "left").join(parents, ["k1", "k2"], "left").join(end_digests(end_keys(cut)), ["k1", "k2"], "left")
    none = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", none).alias("n_leaves"),
        (F.coalesce("all_saved", none) - F.col("over") - F.coalesce("before", none)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """The trie of conversations as they are, of ``rows(conv_id, turn, role, text)``."""
    return prefix_trie(numbered(rows), length)


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 5, h being crc32(c) % 9."""
    turns = materialize(turns, "numbered")
    convs = turns.select("conv_id").distinct()
    own = turns.filter(F.col("pos") > head_turns(F.col("conv_id")))
    step = F.explode(F.when(F.col("conv_id") > 0, F.sequence(F.lit(0), F.lit(4))).when(F.col("conv_id") < 0, F.sequence(F.lit(-4), F.lit(0))).otherwise(F.sequence(F.lit(-4), F.lit(4))))
    lent = turns.filter("pos <= 8 AND conv_id % 5 = 0").select("conv_id", step.alias("step"), "pos", "a", "b", "n").withColumn("conv_id", F.col("conv_id") + F.col("step")).drop("step")
    lent = lent.filter(F.col("pos") <= head_turns(F.col("conv_id"))).join(convs, "conv_id", "left_semi")
    none = F.lit(0).cast("long")
    return own.unionByName(lent).unionByName(convs.select("conv_id", *(none.alias(c) for c in ("pos", "a", "b", "n"))))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_conversation_prefix_trie": op11_conversation_prefix_trie}
ORACLE_SQL = {
    "op11_conversation_prefix_trie": r"""WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT range AS byte, range AS x, 0 AS k FROM range(256)),
step AS (SELECT * FROM (WITH RECURSIVE s AS (SELECT byte, x, k FROM bits UNION ALL SELECT byte, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM s WHERE k < 8) SELECT byte, x FROM s WHERE k = 8)),
crc AS (SELECT c, xor(x, 4294967295) AS crc FROM (WITH RECURSIVE r AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS x FROM t
  UNION ALL SELECT c, s[2:], xor(r.x >> 8, step.x) FROM r JOIN step ON step.byte = xor(r.x & 255, ascii(s)) WHERE s <> '') SELECT c, x FROM r WHERE s = '')),
h AS (SELECT c, crc % 9 AS h FROM crc),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS l FROM t GROUP BY c),
seq AS (SELECT h.c, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:]) AS l FROM h JOIN own o ON o.c = h.c LEFT JOIN own b ON b.c = h.c - h.c % 5),
pre AS (SELECT c, d, len(l) AS n, sha256(CAST(l[1:d] AS VARCHAR)) AS k, sha256(CAST(l[1:d - 1] AS VARCHAR)) AS up, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS bytes
  FROM seq, unnest(range(0, len(l) + 1)) AS u(d)),
node AS (SELECT k, d, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM pre GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (k, d)),
below AS (SELECT DISTINCT a.k AS k, a.d AS d, b.k AS bk, b.d AS bd FROM pre a JOIN pre b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT below.k, below.d, count(*) FILTER (WHERE v.kids = 0) AS leaves, sum((v.n - 1) * v.bytes) AS saved FROM below JOIN full_node v ON v.k = below.bk AND v.d = below.bd GROUP BY ALL)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_node x JOIN sums s ON s.k = x.k AND s.d = x.d LEFT JOIN node p ON x.d > 0 AND p.k = x.up AND p.d = x.d - 1""",
}
