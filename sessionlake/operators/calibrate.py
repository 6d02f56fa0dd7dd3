"""Threshold calibration: statistics of all pairs' similarities, and thresholds carried to another embedding space."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.checkpoints import checkpointed
from sessionlake.functions.text import round4
from sessionlake.functions.vectors import normalized
from sessionlake.operators.graph import PRODUCTS, _codes, _matrix, dots, slack, tiled

#: Fixed values.
ANCHORS = {"link": 0.70, "merge": 0.70, "judge_low": 0.60, "floor": 0.55}
TOLERANCE, MIN_NOTES = 0.02, 200


#: Rows and columns of similarities that are summed from left to right at once; of rough ones; how finely these are counted.
ROWS, COLUMNS, SIDE, BINS = 256, 2048, 1024, 65_536
#: Ranges of similarities for rank correlation; pairs that are ranked within their ranges at once.
RANGES, MOST_RANKED = 1 << 20, 50_000_000


def scaled(vectors: DataFrame) -> DataFrame:
    """``vectors(id, embedding)`` at unit length, as ``tiled`` takes them; a vector without an id is in no pair."""
    return vectors.filter("id IS NOT NULL").select("id", normalized(F.col("embedding")).alias("v"), F.lit(0).alias("group"))


def tiles(vectors: DataFrame, fold: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``fold(i, j, s)`` gives for blocks of the pairs of ``vectors(id, embedding)``, scaled to unit length first.

    ``s`` are the similarities of pairs i < j, summed from left to right. Only what ``fold`` gives leaves a task; vectors are sent once
    to each of the tiles that they are in, see ``graph.tiled``.
    """
    # Written, or else each vector would be scaled again for every tile it is sent to.
    unit = checkpointed(scaled(vectors))

    def multiply(a_ids: pa.Array, a: np.ndarray, b_ids: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        own, y_ids = b is None, b_ids.to_numpy(zero_copy_only=False)
        x_ids, other = a_ids.to_numpy(zero_copy_only=False), a if own else b
        for p in range(0, len(a), ROWS):
            for q in range(0, len(other), COLUMNS):
                left, right = a[p : p + ROWS], other[q : q + COLUMNS]
                total = np.zeros((len(left), len(right)))
                product = np.empty_like(total)
                for x, y in zip(np.ascontiguousarray(left.T), np.ascontiguousarray(right.T), strict=True):
                    np.multiply(x[:, None], y, out=product)
                    total += product
                x, y = np.meshgrid(x_ids[p : p + ROWS], y_ids[q : q + COLUMNS], indexing="ij")
                kept = x < y if own else np.ones(total.shape, bool)
                x, y, s = x[kept], y[kept], total[kept]
                if not np.isfinite(s).all():
                    raise ValueError("a vector that is not finite")
                if len(s):
                    yield pa.RecordBatch.from_pandas(fold(np.where(x < y, x, y), np.where(x < y, y, x), s), preserve_index=False)

    return tiled(unit, None, multiply, schema)


Block = tuple[slice, slice, np.ndarray, np.ndarray | None]


def blocks(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None, kind: type) -> Iterator[Block]:
    """(rows of ``a``, rows of ``b``, their products, pairs that count) of a tile in blocks; None: all pairs count.

    Products are made as numbers of ``kind``, in any order of sums. Of ``a`` alone each unordered pair counts once; a row is no pair with
    one of equal id, which is always in the same part.
    """
    y = a if b is None else b
    if len(a) < (2 if b is None else 1) or not len(y):
        return
    if not (np.isfinite(a).all() and np.isfinite(y).all()):
        raise ValueError("a vector that is not finite")
    code = _codes(ids) if b is None else None
    repeated = code is not None and len(np.unique(code)) < len(code)
    u, w = (a.astype(kind), y.astype(kind)) if b is not None else (a.astype(kind),) * 2
    for p in range(0, len(a), SIDE):
        for q in range(p if b is None else 0, len(y), SIDE):
            rows, columns = slice(p, min(p + SIDE, len(a))), slice(q, min(q + SIDE, len(y)))
            s = u[rows] @ w[columns].T
            own = b is None and p == q
            counts = np.triu(np.ones(s.shape, bool), 1) if own else np.ones(s.shape, bool) if repeated else None
            if repeated:
                counts &= np.not_equal.outer(code[rows], code[columns])
            yield rows, columns, s, counts


def between(block: Block, a: np.ndarray, b: np.ndarray, low: float, high: float, off: float) -> tuple[int, np.ndarray]:
    """How many pairs of a block are below ``low``, and the similarities of those from ``low`` on that are below ``high``.

    Pairs whose rough product is within ``off`` of these are summed from left to right; others are told by it.
    """
    rows, columns, s, counts = block
    least, most = np.float32(low - off), np.float32(high + off)
    less, upto = s < least, s <= most
    if counts is not None:
        less, upto = less & counts, upto & counts
    below = int(np.count_nonzero(less))
    if below == np.count_nonzero(upto):
        return below, np.zeros(0)
    r, c = np.nonzero(upto & ~less)
    exact = dots(a, b, r + rows.start, c + columns.start)
    return below + int((exact < low).sum()), exact[(exact >= low) & (exact < high)]


def _size(block: Block) -> int:
    return block[2].size if block[3] is None else int(np.count_nonzero(block[3]))


def pairwise(vectors: DataFrame) -> DataFrame:
    """(i, j, s) of all pairs i < j, for small corpora: these are many rows. All else folds them in tasks."""
    kind = vectors.schema["id"].dataType.simpleString()
    return tiles(vectors, lambda i, j, s: pd.DataFrame({"i": i, "j": j, "s": s}), f"i {kind}, j {kind}, s double")


def summary(vectors: DataFrame) -> DataFrame:
    """(pairs, mean, sd) of all pairs' similarities, four places. No pair is made, as sums of all products come of sums over vectors.

    The sum of all products u v is (S S - own) / 2, where S is the sum of all vectors, and that of their squares (G G - own) / 2, where
    G is the sum of all u u'. What is to be taken off are the same products of the S and G of each id.
    """
    unit = scaled(vectors).select("id", "v").repartition("id").sortWithinPartitions("id")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = same = 0
        own, at = np.zeros(2), None
        total = gram = held = None

        def closed(count: int, s: np.ndarray, g: np.ndarray) -> None:
            nonlocal same
            same += count * count
            own[:] += s @ s, (g * g).sum()

        for batch in batches:
            width = pc.max(pc.list_value_length(batch["v"])).as_py() if batch.num_rows else 0
            for start in range(0, batch.num_rows, step := max(1, PRODUCTS // max(1, width))):
                rows = pa.Table.from_batches([batch.slice(start, step)])
                x, ids = _matrix(rows), rows["id"].combine_chunks()
                if total is None:
                    total, gram = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
                if len(total) != x.shape[1]:
                    raise ValueError("vectors of different lengths")
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
                firsts = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
                ends = np.append(firsts[1:], len(x))
                inner = np.zeros(len(firsts), bool)
                inner[1:-1] = (ends - firsts)[1:-1] == 1  # ids of one row, which neither goes on from before nor may go on
                q = (x[firsts[inner]] ** 2).sum(1)
                same += len(q)
                own += q.sum(), (q * q).sum()
                for k in np.flatnonzero(~inner).tolist():
                    part = x[firsts[k] : ends[k]]
                    run = [len(part), part.sum(0), part.T @ part]
                    if held is not None and at != ids[firsts[k]].as_py():
                        closed(*held)
                        held = None
                    at, held = ids[firsts[k]].as_py(), run if held is None else [h + r for h, r in zip(held, run, strict=True)]
        if total is not None:
            closed(*held)
            kind = [0] * len(total) + [1] * gram.size + [2, 3]
            place = [*range(len(total)), *range(gram.size), 0, 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array(np.concatenate([total, gram.ravel(), own])), pa.array([len(total)] * len(kind), pa.int32()), pa.array([n, *[0] * (len(kind) - 1)]), pa.array([same, *[0] * (len(kind) - 1)])],
                ("kind", "place", "x", "width", "n", "same"),
            )

    sums = unit.mapInArrow(add, "kind int, place long, x double, width int, n long, same long")
    places = sums.groupBy("kind", "place").agg(F.sum("x").alias("x"), F.min("width").alias("lo"), F.max("width").alias("hi"), F.sum("n").alias("n"), F.sum("same").alias("same"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    x = F.col("x")
    whole = places.agg((of(0, x * x) - of(2, x)).alias("twice"), (of(1, x * x) - of(3, x)).alias("squares"), F.sum("n").alias("n"), F.sum("same").alias("same"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = F.coalesce(F.expr("(n * n - same) div 2"), F.lit(0).cast("long"))
    differ = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("vectors of different lengths")).cast("long"))
    counted = whole.select(F.coalesce(differ, pairs).alias("pairs"), "twice", "squares")
    mean = F.when(F.col("pairs") > 0, F.col("twice") / (2 * F.col("pairs")))
    spread = F.when(F.col("pairs") > 0, F.greatest(F.lit(0.0), F.col("squares") / (2 * F.col("pairs")) - mean * mean))
    finite = F.when(F.coalesce(F.abs("squares") < float("inf"), F.col("pairs") == 0), F.col("pairs")).otherwise(F.raise_error(F.lit("a vector that is not finite")).cast("long"))
    return counted.select(finite.alias("pairs"), round4(mean).alias("mean"), round4(F.sqrt(spread)).alias("sd"))


def density(vectors: DataFrame, anchors: dict[str, float] = ANCHORS) -> DataFrame:
    """(anchor, density): the share of pairs at or above each anchor."""
    names, values = [*anchors], [*anchors.values()]

    def count(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        y, total, below = a if b is None else b, 0, [0] * len(values)
        for block in blocks(ids, a, others, b, np.float32):
            total += _size(block)
            for k, v in enumerate(values):
                below[k] += between(block, a, y, v, v, 2 * slack(a.shape[1]))[0]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total - n for n in below], pa.int64()), pa.array([total] * len(names), pa.int64())], ("anchor", "n", "of"))

    counted = tiled(checkpointed(scaled(vectors)), None, count, "anchor string, n long, of long")
    return counted.groupBy("anchor").agg((F.sum("n") / F.sum("of")).alias("density"))


def _counts(found: np.ndarray) -> list[pa.Array]:
    place = np.flatnonzero(found)
    return [pa.array(place), pa.array(found[place])]


def _bins(s: np.ndarray, bins: int) -> np.ndarray:
    """Ranges of similarities, numbered."""
    return np.clip(s * s.dtype.type(bins / 2) + s.dtype.type(bins / 2), 0, bins - 1).astype(np.int64)


def threshold_at(vectors: DataFrame, densities: dict[str, float]) -> DataFrame:
    """(anchor, threshold): the similarity at index floor((1 - density) * n) of all in ascending order, four places.

    Not a percentile function, which takes another rank. Tasks count rough products by ``BINS`` ranges, of which the driver gets no
    more than that. As a product is off by at most ``slack``, so is the one at an index; a second pass counts what is below the
    range it may be in, and what is in it, exactly. Rounding keeps the order, so what is in it is counted by rounded value.
    """
    unit = checkpointed(scaled(vectors))

    def histogram(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BINS, np.int64)
        for _, _, s, counts in blocks(ids, a, others, b, np.float32):
            found += np.bincount(_bins(s.ravel() if counts is None else s[counts], BINS), minlength=BINS)
        yield pa.RecordBatch.from_arrays(_counts(found), ("bin", "n"))

    rough = tiled(unit, None, histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    if not rough:
        return vectors.sparkSession.createDataFrame([], "anchor string, threshold double")
    ends = np.cumsum([r["n"] for r in rough])
    total = int(ends[-1])
    index = {anchor: min(total - 1, max(0, int((1 - share) * total // 1))) for anchor, share in densities.items()}
    wanted = {anchor: rough[int(np.searchsorted(ends, i, side="right"))]["bin"] for anchor, i in index.items()}
    hit = sorted({*wanted.values()})

    def settle(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        off = 2 * slack(a.shape[1])
        rows: Counter[tuple[int, float | None]] = Counter()
        for block in blocks(ids, a, others, b, np.float32):
            for k in hit:
                below, inside = between(block, a, a if b is None else b, k * 2 / BINS - 1 - off, (k + 1) * 2 / BINS - 1 + off, off)
                rows[k, None] += below
                for value, n in zip(*np.unique(np.floor(inside * 10000 + 0.5) / 10000, return_counts=True), strict=True):
                    rows[k, float(value)] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.float64()), pa.array([*rows.values()], pa.int64())], ("bin", "s", "n"))

    found = tiled(unit, None, settle, "bin long, s double, n long").groupBy("bin", "s").agg(F.sum("n").alias("n")).orderBy("bin", F.asc_nulls_first("s")).collect()
    rows = []
    for anchor, k in wanted.items():
        values = [(r["s"], r["n"]) for r in found if r["bin"] == k]
        upto = np.cumsum([n for _, n in values])
        rows.append((anchor, values[int(np.searchsorted(upto, index[anchor], side="right"))][0]))
    return vectors.sparkSession.createDataFrame(rows, "anchor string, threshold double")


def ranked(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """``pairs`` with the rank of ``value`` from 1, their position settling ties; ranges of values are sorted by themselves."""
    ranges = pairs.withColumn("_range", F.floor(F.col(value) * 1000))
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(value, "i", "j"))
    return ranges.withColumn(name, within).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


def spearman(pairs: DataFrame) -> DataFrame:
    """(spearman) of ``pairs(i, j, s, t)``: ranks by value, the pair's position settling ties, without averaging."""
    return ranked(ranked(checkpointed(pairs), "s", "x"), "t", "y").agg(round4(F.corr("x", "y")).alias("spearman"))


def _floored(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """(spearman) of the similarities of all pairs of ids in both of two spaces; ranks as in ``spearman``, but no list of all pairs is written.

    Tasks count pairs by fine ranges (``RANGES``) of either similarity. The middle ranks of these give the correlation up to an
    error that the counts bound; as four places are wanted, that is mostly enough. Where it is not, what ranks add within their
    ranges is summed as well, see ``_within``; what then is left out is a product of two such errors. Where that is too much, as
    many pairs are equal in both spaces, all pairs are written and ranked after all.
    """
    spark, split = one.sparkSession, F.size("embedding").cast("double")
    of = lambda df, name: scaled(df).select("id", F.col("v").alias(name))
    sized = one.filter("id IS NOT NULL").select("id", F.array(split).alias("split")).distinct()
    both = of(one, "v").join(of(other, "w"), "id").join(sized, "id").select("id", F.concat("split", "v", "w").alias("v"), F.lit(0).alias("group"))
    unit = checkpointed(both)

    def histogram(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, RANGES), np.int64)
        for _, _, pair in _both(ids, a, others, b):
            for k, s in enumerate(pair):
                np.add(found[k], np.bincount(_bins(s, RANGES), minlength=RANGES), out=found[k])
        for k in 0, 1:
            places, n = _counts(found[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(places), pa.int32()), places, n], ("side", "bin", "n"))

    counted = tiled(unit, None, histogram, "side int, bin long, n long").groupBy("side", "bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, RANGES), np.int64)
    n[counted["side"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
    total = int(n[0].sum())
    if total < 2:
        return spark.createDataFrame([(None,)], "spearman double")
    ends = np.cumsum(n, axis=1)
    ranks = ((ends - n + ends + 1) / 2 - (total + 1) / 2) / total  # the middle of a range's ranks, from the middle of all
    left = [math.sqrt((n[k].astype(float) ** 3 - n[k]).sum() / (float(total) ** 3 - total)) for k in (0, 1)]
    shared = spark.sparkContext.broadcast(ranks)

    def products(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        sums = [float(shared.value[0][_bins(s, RANGES)] @ shared.value[1][_bins(t, RANGES)]) for _, _, (s, t) in _both(ids, a, others, b)]
        yield pa.RecordBatch.from_arrays([pa.array([math.fsum(sums)])], ("x",))

    scale = 12 / (total - 1 / total)
    found, error = scale * tiled(unit, None, products, "x double").agg(F.sum("x")).first()[0], sum(left) + left[0] * left[1] + 1e-9
    if _floored(found - error) != _floored(found + error):
        found, error = found + scale * sum(_within(unit, n[k], k, shared, total) for k in (0, 1)), left[0] * left[1] + 1e-9
        if left[0] * left[1] > 1e-9 and _floored(found - error) != _floored(found + error):
            return spearman(pairwise(one).join(pairwise(other).withColumnRenamed("s", "t"), ["i", "j"]))
    return spark.createDataFrame([(_floored(min(1.0, max(-1.0, found))),)], "spearman double")


def _both(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(i, j, similarities in both spaces) of a tile's pairs by blocks, of vectors that have the first one's length, the first and the second in one."""
    y = a if b is None else b
    if not len(a) or not len(y):
        return
    split = int(a[0, 0]) + 1
    if (a[:, 0] + 1 != split).any() or (y[:, 0] + 1 != split).any():
        raise ValueError("vectors of different lengths")
    part = lambda x, k: None if x is None else x[:, 1:split] if k == 0 else x[:, split:]
    for (rows, columns, s, counts), (*_, t, _) in zip(*(blocks(ids, part(a, k), others, part(b, k), float) for k in (0, 1)), strict=True):
        i, j = np.nonzero(np.ones(s.shape, bool) if counts is None else counts)
        yield i + rows.start, j + columns.start, (s[i, j], t[i, j])


def _within(unit: DataFrame, n: np.ndarray, side: int, shared: Broadcast, total: int) -> float:
    """The sum of what ranks on ``side`` are off the middle of their range, times the other side's middle ranks.

    Only pairs of ranges that hold several are written, at most ``MOST_RANKED`` at once (or one range's), so disk is bounded; each
    time all products are made again.
    """
    kind, several = unit.schema["id"].dataType.simpleString(), np.where(n > 1, n, 0)
    upto, found, low = np.cumsum(several), 0.0, 0
    while low < len(n) and upto[-1] > (done := int(upto[low - 1]) if low else 0):
        high = max(low + 1, int(np.searchsorted(upto, done + MOST_RANKED, side="right")))
        chosen = (several[low:high] > 0, low, high)

        def listed(ids: pa.Array, a: np.ndarray, others: pa.Array, b: np.ndarray | None, chosen: tuple = chosen) -> Iterator[pa.RecordBatch]:
            wanted, low, high = chosen
            y, y_ids, split = a if b is None else b, ids if b is None else others, int(a[0, 0]) + 1 if len(a) else 1
            own = slice(1, split) if side == 0 else slice(split, None)
            for i, j, pair in _both(ids, a, others, b):
                places = _bins(pair[side], RANGES)
                hit = np.flatnonzero((places >= low) & (places < high))
                hit = hit[wanted[places[hit] - low]]
                if len(hit):
                    i, j = i[hit], j[hit]
                    ends = ids.take(pa.array(i)), y_ids.take(pa.array(j))
                    values = pa.array(places[hit]), pa.array(dots(a[:, own], y[:, own], i, j)), pa.array(shared.value[1 - side][_bins(pair[1 - side][hit], RANGES)])
                    yield pa.RecordBatch.from_arrays([*values, pc.min_element_wise(*ends), pc.max_element_wise(*ends)], ("bin", "s", "rank", "i", "j"))

        pairs = tiled(unit, None, listed, f"bin long, s double, rank double, i {kind}, j {kind}")
        place = F.row_number().over(Window.partitionBy("bin").orderBy("s", "i", "j"))
        each = pairs.withColumn("place", place).groupBy("bin").agg(F.sum(F.col("place") * F.col("rank")).alias("x"), F.sum("rank").alias("r"), F.count("*").alias("n"))
        found += each.agg(F.sum(F.col("x") - F.col("r") * (F.col("n") + 1) / 2)).first()[0] / total
        low = high
    return found


def carried(reference: DataFrame, other: DataFrame, anchors: dict[str, float] = ANCHORS) -> DataFrame:
    """(anchor, threshold): where the ``other`` vectors' pairs are as dense as the ``reference`` vectors' are at the anchors."""
    found = {r["anchor"]: r["density"] for r in density(reference, anchors).collect()}
    return threshold_at(other, found)


def reconciled(synthetic: dict[str, float], private: dict[str, float] | None, tolerance: float = TOLERANCE) -> dict[str, float]:
    """Thresholds of the synthetic corpus, but a private corpus's where they differ by more than the tolerance."""
    return {k: private[k] if private and abs(private[k] - v) > tolerance else v for k, v in synthetic.items()}
