"""Queries over vectors: links, backbone, search, checks, calibration and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import calibrate, decisions, graph, search
from sessionlake.plans.tables import table

#: The test vectors are far less alike than real notes' are, so thresholds are lower than the shipped ones.
THRESHOLD, FLOOR, QUERY_ID = 0.25, 0.25, 0
RAIL = decisions.Rail(0.25, 0.40, 0.30, 0.25)
ANCHORS = {"link": 0.20, "merge": 0.25, "judge_low": 0.30, "floor": 0.40}


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("repo"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == QUERY_ID).first()["embedding"])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def threshold_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.links(vectors(spark, d), THRESHOLD)


def link_topk(spark, d):
    return rounded(threshold_links(spark, d), "similarity")


def backbone_topk(spark, d):
    return graph.backbone(vectors(spark, d))


def merged_edges(spark, d):
    return rounded(graph.merged(threshold_links(spark, d), graph.backbone(vectors(spark, d))), "similarity")


def boosted_edges(spark, d):
    return rounded(graph.boosted(graph.merged(threshold_links(spark, d), graph.backbone(vectors(spark, d))), vectors(spark, d)), "weight")


def others(spark, d) -> DataFrame:
    return vectors(spark, d).filter(F.col("id") != QUERY_ID).select("id", F.col("v").alias("embedding"))


def edge_best_neighbor(spark, d):
    anchors = search.scored(others(spark, d), query_vector(spark, d), FLOOR)
    return rounded(graph.best_edges(threshold_links(spark, d).filter(f"a <> {QUERY_ID} AND b <> {QUERY_ID}"), anchors), "similarity")


def search_onehop(spark, d):
    notes = others(spark, d)
    edges = threshold_links(spark, d).filter(f"a <> {QUERY_ID} AND b <> {QUERY_ID}")
    none = notes.limit(0)
    return rounded(search.search(notes, notes, none, none, edges, query_vector(spark, d), 20, floor=FLOOR), "similarity")


def check_topk(spark, d):
    found = decisions.check(others(spark, d).select("id"), others(spark, d), query_vector(spark, d), 0.2)
    return rounded(found, "similarity")


def dated(spark, d) -> DataFrame:
    return others(spark, d).withColumn("decided_at", F.when(F.col("id") % 7 != 0, F.concat(F.lit("2024-"), F.lpad((F.col("id") * 31 % 97).cast("string"), 3, "0"))))


def standing_topic(spark, d):
    found = decisions.standing_on_topic(dated(spark, d).select("id", "decided_at"), others(spark, d), query_vector(spark, d), 0.05, 50)
    return rounded(found, "similarity")


def standing_recent(spark, d):
    return decisions.standing(dated(spark, d).select("id", "decided_at"), 50)


def dedup_ladder_bands(spark, d):
    """Every pair from the floor on, however many one vector has."""
    near = graph.similar(vectors(spark, d), None, RAIL.floor)
    pairs = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "similarity")
    return rounded(pairs.withColumn("band", decisions.band(F.col("similarity"), F.lit(False), RAIL)), "similarity")


def guarded_bands(spark, d):
    """Pairs by band where similarity alone merges nothing, by the stored thresholds and by this one; vectors of a label are exact copies if their ids say so."""
    near = graph.similar(vectors(spark, d), None, RAIL.floor)
    found = []
    for model, shift in ((None, 0.0), ("hosted", 0.3), ("local-384", 0.25)):
        rail = RAIL if model is None else decisions.rail_for(model)
        exact = (F.col("src") + F.col("dst")) % 50 == 0
        for name, r in (("plain", rail), ("guarded", rail.guarded())):
            found.append(F.struct(F.lit(model or "test").alias("model"), F.lit(name).alias("rail"), decisions.band(F.col("similarity") + shift, exact, r).alias("band")))
    return near.select(F.explode(F.array(*found)).alias("f")).groupBy("f.model", "f.rail", "f.band").count().withColumnRenamed("count", "n")


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d)
    return v.select("id", F.slice("v", 1, 32).alias("embedding")), v.select("id", F.slice("v", 33, 32).alias("embedding"))


def corpus(spark, d) -> DataFrame:
    return vectors(spark, d).select("id", F.col("v").alias("embedding"))


def pairwise_cosine_stats(spark, d):
    return calibrate.summary(corpus(spark, d))


def density_at_anchor(spark, d):
    return calibrate.density(corpus(spark, d), ANCHORS)


def threshold_at_density(spark, d):
    return calibrate.threshold_at(corpus(spark, d), {"link": 0.0436, "judge_low": 0.2091, "floor": 0.3756})


def calibration_carried(spark, d):
    a, b = halves(spark, d)
    return calibrate.carried(a, b, ANCHORS)


def spearman_subspaces(spark, d):
    return calibrate.agreement(*halves(spark, d))


def reconcile_overlap(spark, d):
    v = table(spark, d, "embeddings")
    components = v.select(F.col("label").alias("component"), F.col("vec_id").alias("id"))
    projects = v.select(F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).when((F.col("label") >= 7) & (F.col("vec_id") % 2 == 0), F.col("label") + 10).otherwise(F.col("label")).alias("project"), F.col("vec_id").alias("id"))
    return graph.reconcile(components, projects)


def cluster_stats(spark, d):
    return graph.cluster_stats(table(spark, d, "embeddings").select(F.when(F.col("label") < 5, F.col("label").cast("long")).otherwise(F.col("vec_id") + 100).alias("community")))


def cluster_order(spark, d):
    found = graph.numbered(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community")))
    return found.select("id", "community", "cluster", "size")


def louvain_clusters(spark, d, most_links=graph.MOST_LINKS):
    notes = vectors(spark, d)
    weights = graph.boosted(graph.merged(threshold_links(spark, d), graph.backbone(notes)), notes)
    return graph.numbered(graph.clusters(notes.select("id"), weights, most_links=most_links))


def louvain_by_joins(spark, d):
    """The same notes, with no component left to a task: every level is moved and folded by joins."""
    return louvain_clusters(spark, d, most_links=0)


def reembed_missing(spark, d):
    from sessionlake.operators.notes import missing_vectors

    return missing_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


def reembed_orphans(spark, d):
    from sessionlake.operators.notes import without_orphans

    return without_orphans(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS repo, label FROM embeddings)"
LINKS = f"""{V}, s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM s WHERE sim >= {THRESHOLD}) WHERE rn <= 10),
links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(sim) AS similarity FROM near GROUP BY 1, 2)"""
BACKBONE = """backbone AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 0.5 AS similarity FROM (
  SELECT s.src, s.dst, row_number() OVER (PARTITION BY s.src ORDER BY s.sim DESC, s.dst) AS rn FROM s JOIN v x ON x.id = s.src JOIN v y ON y.id = s.dst WHERE x.repo = y.repo) WHERE rn <= 3)"""
MERGED = "merged AS (SELECT * FROM links UNION ALL SELECT * FROM backbone b WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.a = b.a AND l.b = b.b))"
QUERY = f"""q AS (SELECT v.id, list_cosine_similarity(v.e, x.e) AS sim FROM v, (SELECT e FROM v WHERE id = {QUERY_ID}) x WHERE v.id <> {QUERY_ID}),
anchors AS (SELECT * FROM q WHERE sim >= {FLOOR})"""
CROSSING = f"""best AS (SELECT CASE WHEN y.id IS NULL THEN l.b ELSE l.a END AS id, max(l.similarity) AS similarity
  FROM links l LEFT JOIN anchors x ON x.id = l.a LEFT JOIN anchors y ON y.id = l.b
  WHERE l.a <> {QUERY_ID} AND l.b <> {QUERY_ID} AND (x.id IS NULL) <> (y.id IS NULL) GROUP BY 1)"""
DATED = "d AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN '2024-' || lpad(CAST(vec_id * 31 % 97 AS VARCHAR), 3, '0') END AS decided_at FROM embeddings WHERE vec_id <> 0)"


def _pairs(name: str, e: str) -> str:
    """All pairs i < j of the vectors ``e``, scaled to unit length; as CTEs."""
    return f"{name} AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM (SELECT id, {e} AS e FROM v) a JOIN (SELECT id, {e} AS e FROM v) b ON a.id < b.id)"


def _at(pairs: str, wanted: str) -> str:
    return f"""SELECT w.anchor, floor(r.s * 10000 + 0.5) / 10000 AS threshold FROM ({wanted}) w
JOIN (SELECT s, row_number() OVER (ORDER BY s) - 1 AS rn, count(*) OVER () AS n FROM {pairs}) r
ON r.rn = greatest(0, least(r.n - 1, CAST(floor((1 - w.density) * r.n) AS BIGINT)))"""


_ANCHOR_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS anchor, avg(CASE WHEN s >= {v} THEN 1.0 ELSE 0.0 END) AS density FROM {{0}}" for k, v in ANCHORS.items())

QUERIES = {
    f.__name__: f
    for f in (
        search_onehop, link_topk, backbone_topk, merged_edges, boosted_edges, edge_best_neighbor, check_topk, standing_topic, standing_recent, dedup_ladder_bands, guarded_bands, pairwise_cosine_stats, density_at_anchor,
        threshold_at_density, calibration_carried, spearman_subspaces, reconcile_overlap, cluster_stats, cluster_order, louvain_clusters, louvain_by_joins, reembed_missing, reembed_orphans,
    )
}
ORACLE_SQL = {
    "link_topk": f"WITH {LINKS} SELECT a, b, round(similarity, 6) AS similarity FROM links",
    "backbone_topk": f"WITH {LINKS}, {BACKBONE} SELECT a, b, CAST(similarity AS DOUBLE) AS similarity FROM backbone",
    "merged_edges": f"WITH {LINKS}, {BACKBONE}, {MERGED} SELECT a, b, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM merged",
    "boosted_edges": f"WITH {LINKS}, {BACKBONE}, {MERGED} SELECT m.a, m.b, round(CAST(m.similarity AS DOUBLE) + CASE WHEN x.repo = y.repo THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 6) AS weight FROM merged m JOIN v x ON x.id = m.a JOIN v y ON y.id = m.b",
    "edge_best_neighbor": f"WITH {LINKS}, {QUERY}, {CROSSING} SELECT id, round(similarity, 6) AS similarity FROM best",
    "search_onehop": f"""WITH {LINKS}, {QUERY}, {CROSSING},
capped AS (SELECT * FROM best ORDER BY similarity DESC, id LIMIT 400)
SELECT kind, id, round(similarity, 6) AS similarity, via FROM (
  SELECT 'note' AS kind, id, sim AS similarity, 'anchor' AS via FROM anchors UNION ALL SELECT 'note', id, similarity, 'link' FROM capped)
ORDER BY similarity DESC, via, id LIMIT 20""",
    "check_topk": f"WITH {V}, {QUERY} SELECT id, round(sim, 6) AS similarity FROM q WHERE sim >= 0.2 ORDER BY sim DESC, id LIMIT 40",
    "standing_topic": f"""WITH {V}, {QUERY}, {DATED}, t AS (SELECT d.id, d.decided_at, q.sim FROM q JOIN d ON d.id = q.id WHERE q.sim >= 0.05 ORDER BY q.sim DESC, d.id LIMIT 200)
SELECT id, decided_at, round(sim, 6) AS similarity FROM t ORDER BY decided_at DESC NULLS LAST, sim DESC, id LIMIT 50""",
    "standing_recent": f"WITH {DATED} SELECT id, decided_at FROM d ORDER BY decided_at DESC NULLS LAST, id LIMIT 50",
    "dedup_ladder_bands": f"WITH {V} SELECT a, b, round(sim, 6) AS similarity, CASE WHEN sim >= 0.4 THEN 'merge' WHEN sim >= 0.3 THEN 'judge' ELSE 'none' END AS band FROM (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.id < y.id) WHERE sim >= {RAIL.floor}",
    "guarded_bands": f"""WITH {V}, p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= {RAIL.floor}),
m(model, shift, merge, low) AS (VALUES ('test', 0.0, 0.4, 0.3), ('hosted', 0.3, 0.7, 0.6), ('local-384', 0.25, 0.7176, 0.6127)), r(rail) AS (VALUES ('plain'), ('guarded'))
SELECT model, rail, CASE WHEN (a + b) % 50 = 0 THEN 'exact' WHEN rail = 'plain' AND sim + CAST(shift AS DOUBLE) >= CAST(merge AS DOUBLE) THEN 'merge' WHEN sim + CAST(shift AS DOUBLE) >= CAST(low AS DOUBLE) THEN 'judge' ELSE 'none' END AS band, count(*) AS n
FROM p, m, r GROUP BY 1, 2, 3""",
    "pairwise_cosine_stats": f"WITH {V}, {_pairs('p', 'e')} SELECT count(*) AS pairs, floor(avg(s) * 10000 + 0.5) / 10000 AS mean, floor(stddev_pop(s) * 10000 + 0.5) / 10000 AS sd FROM p",
    "density_at_anchor": f"WITH {V}, {_pairs('p', 'e')} {_ANCHOR_ROWS.format('p')}",
    "threshold_at_density": f"WITH {V}, {_pairs('p', 'e')} " + _at("p", "SELECT 'link' AS anchor, CAST(0.0436 AS DOUBLE) AS density UNION ALL SELECT 'judge_low', 0.2091 UNION ALL SELECT 'floor', 0.3756"),
    "calibration_carried": f"WITH {V}, {_pairs('p', 'e[1:32]')}, {_pairs('o', 'e[33:64]')} " + _at("o", _ANCHOR_ROWS.format("p")),
    "spearman_subspaces": f"""WITH {V}, {_pairs("p", "e[1:32]")}, {_pairs("o", "e[33:64]")},
r AS (SELECT row_number() OVER (ORDER BY p.s, p.i, p.j) AS x, row_number() OVER (ORDER BY o.s, o.i, o.j) AS y FROM p JOIN o ON p.i = o.i AND p.j = o.j)
SELECT floor(corr(x, y) * 10000 + 0.5) / 10000 AS spearman FROM r""",
    "reconcile_overlap": """WITH c AS (SELECT label AS component, vec_id AS id, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
p AS (SELECT *, count(*) OVER (PARTITION BY project) AS n FROM (SELECT CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 WHEN label >= 7 AND vec_id % 2 = 0 THEN label + 10 ELSE label END AS project, vec_id AS id FROM embeddings)),
m AS (SELECT component, project FROM c JOIN p ON c.id = p.id GROUP BY component, project, c.n, p.n HAVING count(*) * 1.0 / greatest(c.n, p.n) > 0.5)
SELECT x.component, m.project FROM (SELECT DISTINCT component FROM c WHERE n >= 2) x LEFT JOIN m ON m.component = x.component""",
    "cluster_stats": """SELECT count(*) AS clusters, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons
FROM (SELECT CASE WHEN label < 5 THEN label ELSE vec_id + 100 END AS c, count(*) AS n FROM embeddings GROUP BY 1)""",
    "cluster_order": """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS cluster FROM c)
SELECT e.vec_id AS id, e.label AS community, o.cluster, o.n AS size FROM embeddings e JOIN o ON o.label = e.label""",
    "reembed_missing": "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "reembed_orphans": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
}
