"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import drop_table, materialize, merged


#: A node with one of so many ends of all edges is a hub; there are at most so many hubs.
HUBS = 500


def with_least(ends: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``ends(u, v)`` with ``m`` of their ``u`` in ``least(u, m, n)``, n being the edges of u there.

    Hubs, which are few by definition, are broadcast; so the edges of a hub stay where they are, and only the others meet by a shuffle.
    """
    hubs = least.filter(F.col("n") * HUBS >= edges).select("u", F.col("m").alias("hub"))
    marked = ends.join(F.broadcast(hubs), "u", "left")
    others = marked.filter("hub IS NULL").join(merged(least), "u").select("u", "v", "m")
    return others.unionByName(marked.filter("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, under the least of them, until nothing moves
    (logarithmically many rounds). No neighbourhood is gathered: minima combine before the shuffle, and the joins back
    leave the edges of hubs in place. Loops and repeated edges do no
    harm, edges with a null end are left out. Every round is written to the shared folder, and so are its steps, each of which
    is read several times: as one plan a round would hold the first step some thirty times, for the driver to keep.
    """
    current = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(max_rounds):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = materialize(with_least(both, first, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        second = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        under = with_least(large, second, seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialize(under.unionByName(second.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for done in (current, first, large, second):
            drop_table(done)
        current = following
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still move after {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
