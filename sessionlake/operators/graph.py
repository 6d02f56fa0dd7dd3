"""The similarity graph: top-K links, repository backbone, clusters and their names, and projects that stay the same."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.checkpoints import checkpointed, written
from sessionlake.functions.text import enforce_repo_prefix, normalize_repo, repo_display
from sessionlake.operators.order import row_numbers

#: Fixed values.
LINK_K, BACKBONE_K, BACKBONE_WEIGHT = 10, 3, 0.5
REPO_BOOST, RESOLUTION, OVERLAP = 0.10, 2.0, 0.5
SEED = 1  #: of the order in which nodes are visited
#: Rows of a matrix product; vectors of a part at least; bytes of a part of a tile at most; products that are summed at once.
BLOCK, LEAST_PART, TILE_BYTES, PRODUCTS = 1024, 256, 32 << 20, 1 << 20
#: Links of a connected part that one task clusters; what modularity must gain for another sweep over a larger one.
MOST_LINKS, LEAST_GAIN = 500_000, 1e-4


def dots(x: np.ndarray, y: np.ndarray, r: np.ndarray | None = None, c: np.ndarray | None = None) -> np.ndarray:
    """Products of rows ``r`` of ``x`` and ``c`` of ``y`` (all in turn by default), summed from left to right, as single vectors would be."""
    n, width = len(x) if r is None else len(r), x.shape[1]
    out, step = np.zeros(n), max(1, PRODUCTS // max(1, width))
    for at in range(0, n if width else 0, step):
        k = slice(at, at + step)
        out[k] = np.cumsum((x[k] if r is None else x[r[k]]) * (y[k] if c is None else y[c[k]]), axis=1)[:, -1]
    return out


def slack(width: int) -> float:
    """By how much a product of unit vectors in single precision may differ from the exact one, at most, in any order of sums."""
    return (width + 4) * 2.0**-23


def _units(x: np.ndarray, norms: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length in single precision (zero where that is no number), and their angles to the row ``pivot``."""
    out, angles, step = np.empty(x.shape, np.float32), np.empty(len(x)), max(1, PRODUCTS // max(1, x.shape[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = lambda rows, n: np.nan_to_num(rows / n, nan=0.0, posinf=0.0, neginf=0.0)
        to = scaled(pivot, np.sqrt((pivot * pivot).sum()))
        for at in range(0, len(x), step):
            k = slice(at, at + step)
            rows = scaled(x[k], norms[k, None])
            out[k], angles[k] = rows, np.arccos(np.clip(rows @ to, -1, 1))
    return out, angles


class Best:
    """The ``k`` best partners of each row so far, and the least similarity that a further one needs; 16 k bytes a row, however many come."""

    def __init__(self, code: np.ndarray, k: int, floor: float) -> None:
        self.code, self.k, self.floor = np.append(code, np.iinfo(np.int64).max), k, floor
        self.to, self.similarity = np.full((len(code), k), -1), np.full((len(code), k), -np.inf)
        self.least = np.full(len(code), floor if k else np.inf)

    def put(self, src: np.ndarray, dst: np.ndarray, s: np.ndarray) -> None:
        """Take pairs of rows; the least code of ``dst`` settles ties."""
        if not len(src) or not self.k:
            return
        rows = np.unique(src)
        src, dst, s = (np.concatenate(x) for x in ((np.repeat(rows, self.k), src), (self.to[rows].ravel(), dst), (self.similarity[rows].ravel(), s)))
        order = np.lexsort((self.code[dst], -s, src))
        src, place = src[order], np.arange(len(src))
        kept = order[place - np.maximum.accumulate(np.where(np.diff(src, prepend=-1) != 0, place, 0)) < self.k]
        self.to[rows], self.similarity[rows] = dst[kept].reshape(-1, self.k), s[kept].reshape(-1, self.k)
        self.least[rows] = np.maximum(self.floor, self.similarity[rows, -1])


def alike(a: np.ndarray, b: np.ndarray | None, floor: float, code: np.ndarray, other: np.ndarray | None, best: Best | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of rows i of ``a`` and j of ``b``, or of pairs of ``a`` alone, by blocks: all of at least ``floor``, or what ``best`` may need.

    Rows are put in order of their angle to one of them, the pivot. Blocks whose angles lie so far apart that no pair can qualify
    are passed over. Of others a matrix product tells which pairs may qualify (``slack``); only these are summed from left to
    right, as single vectors would be. ``best`` has the rows of ``a``, then those of ``b``; the caller puts in what comes, so that a pair
    of a later block must be better than those of the blocks before. Rows of equal ``code`` are no pair, where ``other`` has codes
    for ``b`` or there is no ``b``.
    """
    x, y = a, a if b is None else b
    if not len(x) or not len(y):
        return
    x_norm = np.sqrt(dots(x, x))
    y_norm = x_norm if b is None else np.sqrt(dots(y, y))
    x_unit, x_angle = _units(x, x_norm, x[0])
    y_unit, y_angle = (x_unit, x_angle) if b is None else _units(y, y_norm, x[0])
    x_order, y_order = np.argsort(x_angle, kind="stable"), np.argsort(y_angle, kind="stable")
    x_unit = x_unit[x_order]
    y_unit = x_unit if b is None else y_unit[y_order]
    x_code, y_code = code, code if b is None else other
    repeated = y_code is not None and (len(np.unique(x_code)) < len(x_code) if b is None else bool(np.isin(x_code, y_code).any()))
    least = np.full(len(x), floor) if best is None else best.least[: len(x)]
    under = (least if b is None else np.full(len(y), floor)) if best is None else least if b is None else best.least[len(x) :]
    k, off = None if best is None else best.k, 2 * slack(x.shape[1])
    for p in range(0, len(x), BLOCK):
        i = x_order[p : p + BLOCK]
        for q in range(p if b is None else 0, len(y), BLOCK):
            j = y_order[q : q + BLOCK]
            need, needs = least[i], under[j]
            gap = max(x_angle[i[0]] - y_angle[j[-1]], y_angle[j[0]] - x_angle[i[-1]], 0.0)
            if math.cos(gap) < min(need.min(), needs.min()) - 1e-6:
                continue
            rough = x_unit[p : p + BLOCK] @ y_unit[q : q + BLOCK].T
            own = b is None and p == q
            if own:
                np.fill_diagonal(rough, -np.inf)
            if repeated:
                rough[np.equal.outer(x_code[i], y_code[j])] = -np.inf
            reach = lambda: (rough >= (need - off).astype(np.float32)[:, None]) | (rough >= (needs - off).astype(np.float32))  # noqa: B023, E731
            may = reach()
            if k and np.count_nonzero(may) > 4 * k * (len(i) + len(j)):  # rows that have no k partners yet
                if k < len(j):
                    need = np.maximum(need, np.partition(rough, len(j) - k, axis=1)[:, len(j) - k])
                if k < len(i):
                    needs = np.maximum(needs, np.partition(rough, len(i) - k, axis=0)[len(i) - k])
                may = reach()
            may &= rough > -np.inf
            r, c = np.nonzero(np.triu(may, 1) if own else may)
            r, c = i[r], j[c]
            scale = x_norm[r] * y_norm[c]
            exact = np.where(scale > 0, dots(x, y, r, c) / np.where(scale > 0, scale, 1), 0.0)
            kept = exact >= floor
            yield r[kept], c[kept], exact[kept]


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones."""
    order = pc.sort_indices(ids)
    plain = ids.take(order)
    new = np.ones(len(ids), np.int64)
    new[1:] = pc.fill_null(pc.not_equal(plain[1:], plain[:-1]), True).to_numpy(zero_copy_only=False) if len(ids) > 1 else 0
    out = np.empty(len(ids), np.int64)
    out[order.to_numpy()] = np.cumsum(new)
    return out


def _matrix(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros((0, 0))
    sizes = pc.unique(pc.list_value_length(rows["v"]))
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    out, at = np.empty((rows.num_rows, sizes[0].as_py() or 0)), 0
    for chunk in rows["v"].chunks:
        out[at : at + len(chunk)] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)
        at += len(chunk)
    return out


Fold = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray | None], Iterator[pa.RecordBatch]]


def tiled(left: DataFrame, right: DataFrame | None, fold: Fold, schema: str) -> DataFrame:
    """What ``fold(ids, vectors, other ids, other vectors)`` gives for the tiles of all pairs of ``left(id, v, group)`` and ``right``, within groups.

    Both sides are dealt by hash to as few parts as fit into a task (``TILE_BYTES``), or as many as keep all tasks busy. A tile is a
    pair of parts, so a vector is sent to as many tiles as the other side has parts: with T tiles about n sqrt(2 T) vectors are
    shuffled where ``right`` is None (pairs of one table, of which each unordered pair of parts is one tile; the other vectors
    are None for a part with itself), and 2 n sqrt(T) otherwise. No tile is sent on again, and none holds more than two parts.
    """
    wide = math.isqrt(2 * left.sparkSession.sparkContext.defaultParallelism) + 1
    one = right is None

    def parted(df: DataFrame, name: str) -> DataFrame:
        each = F.greatest(F.lit(LEAST_PART), F.floor(F.lit(TILE_BYTES) / (8 * F.greatest(F.max(F.size("v")), F.lit(1)))))
        return df.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / each), F.least(F.ceil(F.count("*") / LEAST_PART), F.lit(wide)), F.lit(1)).cast("int").alias(name))

    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int").alias("part")
    upto = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    tile = lambda row, column: F.struct(row.alias("row"), column.alias("column"))
    columns = "group", "id", "v", "part", "side"
    if one:
        spread = left.join(parted(left, "parts"), "group").select("group", "id", "v", part("parts"), F.lit(0).alias("side"), "parts")
        sent = spread.select(*columns, F.explode(F.transform(upto("parts"), lambda o: tile(F.least(o, F.col("part")), F.greatest(o, F.col("part"))))).alias("t"))
    else:
        sizes = parted(left, "parts").join(parted(right, "others"), "group")
        a = left.join(sizes, "group").select("group", "id", "v", part("parts"), F.lit(0).alias("side"), "others")
        b = right.join(sizes, "group").select("group", "id", "v", part("others"), F.lit(1).alias("side"), "parts")
        sent = a.select(*columns, F.explode(F.transform(upto("others"), lambda o: tile(F.col("part"), o))).alias("t")).unionByName(
            b.select(*columns, F.explode(F.transform(upto("parts"), lambda o: tile(o, F.col("part")))).alias("t"))
        )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        row, column = rows["row"][0], rows["column"][0]
        of = lambda name, value: rows.filter(pc.equal(rows[name], value))
        first, second = (of("side", 0), of("side", 1)) if not one else (rows, None) if row == column else (of("part", row), of("part", column))
        ids = lambda t: pa.concat_arrays(t["id"].chunks) if t.num_rows else pa.array([], t["id"].type)
        sides = [(ids(t), _matrix(t)) for t in (first, second) if t is not None]
        del rows, first, second  # the matrices are all that is needed, for as long as the tile takes
        yield from fold(*sides[0], *(sides[1] if len(sides) > 1 else (sides[0][0], None)))

    # A number is given, as tiles are small to send but long to work on, so that they must not be put together by their size.
    spread_over = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.select("group", "t.row", "t.column", "part", "side", "id", "v").repartition(spread_over, "group", "row", "column")
    return dealt.groupBy("group", "row", "column").applyInArrow(solve, schema)


def _plain(vectors: DataFrame, within: str | None = None) -> DataFrame:
    v = F.col("v") if vectors.schema["v"].dataType.simpleString() == "array<float>" else F.col("v").cast("array<double>")  # the former are half as long to send
    return vectors.select("id", v.alias("v"), (F.col(within) if within else F.lit(0)).alias("group"))


def neighbours(vectors: DataFrame, threshold: float | None, k: int = LINK_K, within: str | None = None) -> DataFrame:
    """(src, dst, similarity): for each source its ``k`` nearest others of at least ``threshold``, ids settling ties.

    With ``within``, a column, only others of the same value. Exact, see ``tiled`` and ``alike``: a tile gives at most ``k`` rows a source.
    """
    if k < 0 or int(k) != k:
        raise ValueError("k must be a whole number, not negative")
    kind, floor = vectors.schema["id"].dataType.simpleString(), -np.inf if threshold is None else threshold

    def nearest(a_ids: pa.Array, a: np.ndarray, b_ids: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        ids = a_ids if b is None else pa.concat_arrays([a_ids, b_ids])
        code = _codes(ids)
        best = Best(code, k, floor)
        for i, j, s in alike(a, b, floor, code[: len(a)], None if b is None else code[len(a) :], best):
            j = j if b is None else j + len(a)
            best.put(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s]))
        src, place = np.nonzero(best.to >= 0)
        if len(src):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(src)), ids.take(pa.array(best.to[src, place])), pa.array(best.similarity[src, place])], ("src", "dst", "similarity"))

    found = tiled(_plain(vectors, within), None, nearest, f"src {kind}, dst {kind}, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def similar(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(src, dst, similarity): all pairs of ``left(id, v)`` and ``right`` of at least ``threshold``, however many a source has.

    Without ``right``, the pairs of ``left`` alone, each once. A tile's pairs come out block by block as they qualify; nothing ranks
    or gathers them.
    """
    kind, other = (df.schema["id"].dataType.simpleString() for df in (left, left if right is None else right))

    def qualify(a_ids: pa.Array, a: np.ndarray, b_ids: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for i, j, s in alike(a, b, threshold, _codes(a_ids), None):
            yield pa.RecordBatch.from_arrays([a_ids.take(pa.array(i)), b_ids.take(pa.array(j)), pa.array(s)], ("src", "dst", "similarity"))

    return tiled(_plain(left), None if right is None else _plain(right), qualify, f"src {kind}, dst {other}, similarity double")


def undirected(found: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b, each pair once."""
    return found.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("similarity").alias("similarity"))


def links(vectors: DataFrame, threshold: float, k: int = LINK_K) -> DataFrame:
    return undirected(neighbours(vectors, threshold, k))


def backbone(notes: DataFrame, k: int = BACKBONE_K) -> DataFrame:
    """Links of fixed weight to the ``k`` nearest siblings of the same repository, of ``notes(id, v, repo)``, whatever their similarity."""
    own = notes.select("id", "v", normalize_repo(F.col("repo").cast("string")).alias("repo")).filter("repo IS NOT NULL")
    return undirected(neighbours(own, None, k, within="repo")).withColumn("similarity", F.lit(BACKBONE_WEIGHT))


def merged(threshold_links: DataFrame, backbone_links: DataFrame) -> DataFrame:
    """Both kinds of links; where a pair has both, the threshold link."""
    return threshold_links.unionByName(backbone_links.join(threshold_links, ["a", "b"], "left_anti"))


def boosted(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Weights for clustering: links within a repository weigh more. They are never stored."""
    repo = notes.select("id", normalize_repo(F.col("repo").cast("string")).alias("repo"))
    both = edges.join(repo.select(F.col("id").alias("a"), F.col("repo").alias("repo_a")), "a").join(repo.select(F.col("id").alias("b"), F.col("repo").alias("repo_b")), "b")
    return both.select("a", "b", (F.col("similarity") + F.when(F.col("repo_a") == F.col("repo_b"), REPO_BOOST).otherwise(0.0)).alias("weight"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): least id that each node reaches; labels spread and jump until none changes."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = both.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("component").alias("m"))
        spread = labels.join(least, F.col("id") == F.col("x"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("further"))
        following = checkpointed(spread.join(jump, "component", "left").select("id", F.coalesce("further", "component").alias("component")))
        if not following.join(labels.withColumnRenamed("component", "before"), "id").filter("component <> before").head(1):
            return following
        labels = following


def louvain(ids: list, edges: list[tuple], total: float, resolution: float = RESOLUTION, seed: int = SEED) -> dict:
    """Communities of one connected part, by local moves and folding; ``total`` is the weight of all edges of the whole graph.

    A node joins the community whose modularity gain, against the whole graph's weight, is the greatest; the order of visits is
    drawn from ``seed`` over the sorted nodes, and the least label settles ties, so the input's order is of no account. An edge from
    a node to itself is what lies within the node, if it stands for several.
    """
    ids = sorted(ids)
    place = {x: i for i, x in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    loops, member = [0.0] * len(ids), list(range(len(ids)))
    for a, b, w in sorted(edges):
        i, j = place[a], place[b]
        if i == j:
            loops[i] += w
        else:
            near[i][j] = near[j][i] = w
    rng = np.random.default_rng(seed)
    while True:
        n = len(near)
        degree = [sum(near[i].values()) + 2 * loops[i] for i in range(n)]
        label, weight, moved = list(range(n)), degree[:], False
        again = True
        while again:
            again = False
            for i in rng.permutation(n).tolist():
                to: dict[int, float] = {label[i]: 0.0}
                for j, w in near[i].items():
                    to[label[j]] = to.get(label[j], 0.0) + w
                weight[label[i]] -= degree[i]
                gain = {c: w / total - resolution * degree[i] * weight[c] / (2 * total * total) for c, w in to.items()}
                best = max(gain.values())
                if gain[label[i]] < best - 1e-12:
                    label[i] = min(c for c, g in gain.items() if g >= best - 1e-12)
                    again = moved = True
                weight[label[i]] += degree[i]
        if not moved:
            return _named(ids, member)
        fold = {c: k for k, c in enumerate(sorted(set(label)))}
        folded: list[dict[int, float]] = [{} for _ in fold]
        inner = [0.0] * len(fold)
        for i in range(n):
            inner[fold[label[i]]] += loops[i]
            for j, w in near[i].items():
                x, y = fold[label[i]], fold[label[j]]
                if x == y:
                    inner[x] += w / 2
                else:
                    folded[x][y] = folded[x].get(y, 0.0) + w
        member = [fold[label[m]] for m in member]
        near, loops = folded, inner


def _named(ids: list, member: list[int]) -> dict:
    """Each node with the least node of its community."""
    least: dict[int, object] = {}
    for x, m in zip(ids, member, strict=True):
        least.setdefault(m, x)
    return {x: least[m] for x, m in zip(ids, member, strict=True)}


def modularity(edges: DataFrame, communities: DataFrame, total: float, resolution: float = RESOLUTION) -> float:
    """Of ``communities(id, community)`` over ``edges(a, b, weight)``, each once, within a graph whose edges weigh ``total``."""
    of = lambda end: communities.select(F.col("id").alias(end), F.col("community").alias(f"of_{end}"))
    placed = edges.join(of("a"), "a").join(of("b"), "b")
    ends = F.explode(F.array(F.struct(F.col("of_a").alias("c"), F.col("of_b").alias("d")), F.struct(F.col("of_b").alias("c"), F.col("of_a").alias("d")))).alias("e")
    sums = placed.select(ends, "weight").groupBy("e.c").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("e.c") == F.col("e.d"), F.col("weight") / 2)).alias("inner"))
    each = F.coalesce("inner", F.lit(0.0)) / total - resolution * (F.col("volume") / (2 * total)) ** 2
    return sums.agg(F.sum(each)).first()[0] or 0.0


def moved(state: DataFrame, ends: DataFrame, total: float, resolution: float, sweep: int, half: int) -> DataFrame:
    """``state(id, community, degree)`` after all nodes of one half have gone to the best community next to them.

    Halves are drawn by hash anew in each sweep, so that two nodes which would only change places are parted soon. A node stays
    where no other community is better; the least label settles ties. ``ends(x, y, weight)`` holds each edge from both sides.
    """
    chosen = lambda name: F.pmod(F.xxhash64(name, F.lit(sweep)), F.lit(2)) == half
    volumes = state.groupBy("community").agg(F.sum("degree").alias("volume"))
    near = ends.filter(chosen("x")).join(state.select(F.col("id").alias("y"), "community"), "y").select("x", "community", "weight")
    home = state.filter(chosen("id")).select(F.col("id").alias("x"), F.col("community").alias("home"), "degree")
    options = near.unionByName(home.select("x", F.col("home").alias("community"), F.lit(0.0).alias("weight"))).groupBy("x", "community").agg(F.sum("weight").alias("weight"))
    known = options.join(volumes, "community").join(home, "x")
    away = F.col("community") != F.col("home")
    others = F.col("volume") - F.when(away, 0.0).otherwise(F.col("degree"))
    gain = F.col("weight") / total - resolution * F.col("degree") * others / (2 * total * total)
    best = known.groupBy("x").agg(F.min(F.struct(F.round(-gain * total, 9), away, "community"))["community"].alias("to"))
    return state.join(best, F.col("id") == F.col("x"), "left").select("id", F.coalesce("to", "community").alias("community"), "degree")


def settled(edges: DataFrame, total: float, resolution: float = RESOLUTION) -> DataFrame | None:
    """(id, community) of the nodes of ``edges(a, b, weight)`` after local moves by halves, each a few joins; None if no sweep gains.

    A sweep moves both halves once. Sweeps go on until two in a row gain less than ``LEAST_GAIN`` of what modularity these edges can
    have, so there is an end to them; those two are dropped.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    ends = written(both.filter("x <> y"), "ends")
    state = written(both.groupBy("x").agg(F.sum("weight").alias("degree")).select(F.col("x").alias("id"), F.col("x").alias("community"), "degree"), "nodes")
    least = LEAST_GAIN * (edges.agg(F.sum("weight")).first()[0] or 0.0) / total
    best, reached, sweep, idle = None, modularity(edges, state, total, resolution), 0, 0
    while idle < 2:
        for half in 0, 1:
            state = written(moved(state, ends, total, resolution, sweep, half), "nodes")
        now, sweep, idle = modularity(edges, state, total, resolution), sweep + 1, idle + 1
        if now > reached + least:
            best, reached, idle = state.select("id", "community"), now, 0
    return best


def clusters(nodes: DataFrame, weights: DataFrame, resolution: float = RESOLUTION, most_links: int = MOST_LINKS) -> DataFrame:
    """(id, community): Louvain communities, named by their least member; nodes without links are their own.

    No community spans connected components, so each component is a group of its own, which carries the whole graph's weight.
    One of over ``most_links`` is first moved and folded by joins, level by level, until what is left of it fits into a task or
    no move gains any more. Links to unknown nodes and repeated ones are left out.
    """
    known = weights.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    once = checkpointed(known.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight")))
    total = once.agg(F.sum("weight")).first()[0] or 0.0
    id_type = nodes.schema["id"].dataType.simpleString()
    parts = connected(once, nodes)
    graph = once.join(parts.select(F.col("id").alias("a"), "component"), "a")
    member = None  # (id, at): the folded node that stands for each node of a large component
    while True:
        sizes = written(graph.groupBy("component").count().filter(F.col("count") > most_links), "sizes")
        if not sizes.head(1):
            break
        large, graph = written(graph.join(sizes, "component", "left_semi"), "large"), graph.join(sizes, "component", "left_anti")
        found = settled(large.select("a", "b", "weight"), total, resolution)
        if found is None:
            break
        of = lambda end: found.select(F.col("id").alias(end), F.col("community").alias(f"of_{end}"))  # noqa: B023, E731
        joined = large.join(of("a"), "a").join(of("b"), "b")
        folded = joined.groupBy("component", F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).agg(F.sum("weight").alias("weight"))
        graph = written(graph.select("component", "a", "b", "weight").unionByName(folded), "folded")
        further = found.select(F.col("id").alias("at"), "community")
        at = found.select("id", F.col("community").alias("at")) if member is None else member.join(further, "at", "left").select("id", F.coalesce("community", "at").alias("at"))
        member = written(at, "member")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found = louvain([*{*frame["a"], *frame["b"]}], list(frame[["a", "b", "weight"]].itertuples(index=False, name=None)), total, resolution)
        return pd.DataFrame({"id": list(found), "community": list(found.values())})

    solved = graph.select("component", "a", "b", "weight").groupBy("component").applyInPandas(solve, f"id {id_type}, community {id_type}")
    every = nodes.select("id").distinct()
    if member is None:
        return every.join(solved, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    at = every.join(member, "id", "left").select("id", F.coalesce("at", "id").alias("at"))
    ends = checkpointed(at.join(solved.withColumnRenamed("id", "at"), "at", "left").select("id", F.coalesce("community", "at").alias("community")))
    return ends.join(ends.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))


def collated(name: str, df: DataFrame) -> Column:
    """A column for sorting: strings in the order of Unicode's collation, other types as they are."""
    return F.collate(name, "UNICODE") if isinstance(df.schema[name].dataType, StringType) else F.col(name)


def numbered(communities: DataFrame) -> DataFrame:
    """(id, community, cluster): communities numbered from 0 by size, the larger first, then by least member."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    placed = row_numbers(sizes, "place", F.desc("size"), collated("community", sizes), "community").select("community", (F.col("place") - 1).cast("int").alias("cluster"), "size")
    return communities.join(placed, "community").select("id", "community", "cluster", "size")


def cluster_stats(communities: DataFrame) -> DataFrame:
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"))


def reconcile(components: DataFrame, projects: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(component, project): the project that each component of two or more members goes on as, or null for a new one.

    ``components(component, id)`` and ``projects(project, id)`` are partitions. A match holds over half of the larger of both,
    hence over half of either, so it is the only one on either side, and no order of choice is needed.
    """
    a = components.withColumn("size_a", F.count("*").over(Window.partitionBy("component"))).filter("size_a >= 2")
    b = projects.withColumn("size_b", F.count("*").over(Window.partitionBy("project")))
    shared = a.join(b, "id").groupBy("component", "project", "size_a", "size_b").agg(F.count("*").alias("both"))
    match = shared.filter(F.col("both") / F.greatest("size_a", "size_b") > overlap).select("component", "project")
    return a.select("component").distinct().join(match, "component", "left")


def deleted_projects(projects: DataFrame, matches: DataFrame) -> DataFrame:
    return projects.select("project").distinct().join(matches.filter("project IS NOT NULL"), "project", "left_anti")


def changes(components: DataFrame, projects: DataFrame, all_projects: DataFrame) -> DataFrame:
    """(change, n): why components of two or more are not exactly the projects; empty if they are.

    ``joined`` and ``left`` are members on one side only, ``empty`` projects without members, ``parted`` pairs of a component and a
    project that share some members but not all. Both sides are partitions, so sizes tell; no set of members is gathered.
    """
    a = components.withColumn("size_a", F.count("*").over(Window.partitionBy("component"))).filter("size_a >= 2")
    b = projects.withColumn("size_b", F.count("*").over(Window.partitionBy("project")))
    shared = a.join(b, "id", "full_outer").groupBy("component", "project", "size_a", "size_b").agg(F.count("*").alias("both"))
    kind = F.when(F.col("project").isNull(), "joined").when(F.col("component").isNull(), "left").when((F.col("both") < F.col("size_a")) | (F.col("both") < F.col("size_b")), "parted")
    empty = all_projects.join(projects, "project", "left_anti").agg(F.count("*").alias("n")).select(F.lit("empty").alias("change"), "n")
    found = shared.select(kind.alias("change"), F.when(kind == "parted", 1).otherwise(F.col("both")).alias("n")).filter("change IS NOT NULL")
    return found.groupBy("change").agg(F.sum("n").alias("n")).unionByName(empty.filter("n > 0"))


def is_unchanged(components: DataFrame, projects: DataFrame, all_projects: DataFrame) -> bool:
    """Whether components of two or more are exactly the projects; a project without members is a change."""
    return not changes(components, projects, all_projects).head(1)


def dominant_repo(members: DataFrame) -> DataFrame:
    """(cluster, repo): the most frequent repository of ``members(cluster, repo)``, of equals the first as people sort words; null if none."""
    counted = members.select("cluster", normalize_repo(F.col("repo").cast("string")).alias("repo"))
    votes = counted.filter("repo IS NOT NULL").groupBy("cluster", "repo").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), collated("repo", votes), "repo")
    best = votes.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("cluster", "repo")
    return counted.select("cluster").distinct().join(best, "cluster", "left")


def sharing(dominant: DataFrame) -> DataFrame:
    """How many clusters share each one's dominant repository; those without one share that."""
    return dominant.withColumn("sharing", F.count("*").over(Window.partitionBy("repo")))


def fallback_name(position: Column, repo: Column, topic: Column) -> Column:
    """A name without a language model: the repository's sessions, else the first member's topic, else a number."""
    display = repo_display(normalize_repo(repo))
    return F.when(F.coalesce(display, F.lit("")) != "", F.concat(display, F.lit(": Sessions"))).otherwise(F.coalesce(F.nullif(topic, F.lit("")), F.concat(F.lit("Project "), (position + 1).cast("string"))))


def prefixed_names(names: DataFrame) -> DataFrame:
    """``names(cluster, name, repo)`` with the repository's prefix enforced."""
    return names.withColumn("name", enforce_repo_prefix(F.col("name"), F.col("repo")))


def unique_names(taken: list[str], wanted: list[str], attempts: int = 1000) -> list[str]:
    """Names that no other has, ignoring case: a number is added. Only the new projects' names come here, one run's worth."""
    used, out = {t.casefold() for t in taken}, []
    for base in wanted:
        for i in range(1, attempts + 1):
            name = base if i == 1 else f"{base} ({i})"
            if name.casefold() not in used:
                break
        else:
            raise ValueError(f"no free name for {base!r}")
        used.add(name.casefold())
        out.append(name)
    return out


def best_edges(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, similarity): nodes outside ``anchors(id)`` next to one, with their best such link. A link whose similarity is not a finite number fails the job."""
    flag = anchors.select("id", F.lit(True).alias("is"))
    both = edges.join(flag.select(F.col("id").alias("a"), F.col("is").alias("in_a")), "a", "left").join(flag.select(F.col("id").alias("b"), F.col("is").alias("in_b")), "b", "left")
    crossing = both.filter(F.col("in_a").isNull() != F.col("in_b").isNull())
    finite = F.coalesce(F.abs("similarity") < float("inf"), F.lit(False))  # a NaN is above infinity
    bad = F.raise_error(F.concat(F.lit("a link without a similarity: "), F.col("a").cast("string"), F.lit(" "), F.col("b").cast("string"))).cast("double")
    outer = F.when(F.col("in_a").isNull(), F.col("a")).otherwise(F.col("b"))
    sure = F.when(F.col("in_a").isNull() == F.col("in_b").isNull(), None).when(finite, F.col("similarity")).otherwise(bad)
    return crossing.groupBy(outer.alias("id")).agg(F.max(sure).alias("similarity"))
