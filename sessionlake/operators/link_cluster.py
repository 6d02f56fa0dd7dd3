"""Links, clusters and projects of all notes, from a snapshot to the new versions of three tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.checkpoints import checkpointed
from sessionlake.functions.text import enforce_repo_prefix, js_trim
from sessionlake.operators import graph
from sessionlake.operators.notes import require_vectors

#: How often a model is asked for names: again only where it gave too many or too few.
NAME_ATTEMPTS = 2


@dataclass
class Outcome:
    links: DataFrame
    notes: DataFrame
    projects: DataFrame
    unchanged: bool


def asked_names(chat: Callable[[str], str] | None, topics: list) -> list[str] | None:
    """A name for each new cluster, by a chat function that gets descriptions of the clusters as JSON and answers with a JSON list.

    Any failure, or a second answer of the wrong number, means none for all.
    """
    if chat is None or not topics:
        return None
    for _ in range(NAME_ATTEMPTS):
        try:
            names = json.loads(chat(json.dumps(topics)))
        except Exception:  # naming is a courtesy: whatever fails, clusters get plain names
            return None
        if not isinstance(names, list) or not all(isinstance(n, str) and n.strip() for n in names):
            return None
        if len(names) == len(topics):
            return names
    return None


def run(notes: DataFrame, vectors: DataFrame, projects: DataFrame, threshold: float, now: str, chat: Callable[[str], str] | None = None) -> Outcome:
    """A note without vector fails the job. Clusters of two or more are projects; the project that holds over half of one goes on.

    Where clusters are the projects already, notes and projects stay as they are. Names of new projects alone are made; their
    number is small, and they are what comes to the driver; for a chat function, with the topics of all their notes, their repository
    and how many clusters have it, as that is what it is asked.
    """
    known = require_vectors(notes.select("id", F.col("repo_name").alias("repo"), "project_id"), vectors.select("id", "embedding")).withColumnRenamed("embedding", "v")
    edges = checkpointed(graph.merged(graph.links(known, threshold), graph.backbone(known)))
    found = checkpointed(graph.clusters(known.select("id"), graph.boosted(edges, known)))
    stored_links = edges.withColumn("computed_at", F.lit(now))
    component = found.withColumnRenamed("community", "component")
    members = notes.filter("project_id IS NOT NULL").select(F.col("project_id").alias("project"), "id")
    if graph.is_unchanged(component, members, projects.select(F.col("id").alias("project"))):
        return Outcome(stored_links, notes, projects, True)

    match = checkpointed(graph.reconcile(component, members))
    order = graph.numbered(found).groupBy("community").agg(F.first("cluster").alias("cluster"))
    dominant = graph.dominant_repo(component.join(notes.select("id", F.col("repo_name").alias("repo")), "id").select(F.col("component").alias("cluster"), "repo"))
    shared = graph.sharing(dominant.join(match.select(F.col("component").alias("cluster")), "cluster")).select(F.col("cluster").alias("component"), "sharing")
    # A chat function is asked with what every note is about; without one, nothing but the first topic is looked at.
    about = F.coalesce(*(F.nullif(js_trim(c), F.lit("")) for c in ("topic", "conversation_title")), F.lit("untitled"))
    listed = F.array_sort(F.collect_list(F.struct("id", about.alias("about"))))["about"] if chat is not None else F.array().cast("array<string>")
    fresh = match.filter("project IS NULL").select("component").join(component, "component")
    topic = fresh.join(notes.select("id", "topic", "conversation_title"), "id").groupBy("component").agg(F.min_by("topic", "id").alias("first"), listed.alias("topics")).join(shared, "component")
    new = match.filter("project IS NULL").select("component").join(order.withColumnRenamed("community", "component"), "component").join(dominant.withColumnRenamed("cluster", "component"), "component").join(topic, "component")
    position = F.row_number().over(Window.orderBy("cluster")) - 1
    rows = new.withColumn("plain", graph.fallback_name(position, F.col("repo"), F.col("first"))).orderBy("cluster").collect()
    names = asked_names(chat, [{"topics": r["topics"], "repository": r["repo"], "clusters of the repository": r["sharing"] if r["repo"] is not None else None} for r in rows])
    spark = notes.sparkSession
    if names is not None:
        given = spark.createDataFrame([(i, n, r["repo"]) for i, (n, r) in enumerate(zip(names, rows, strict=True))], "i int, name string, repo string")
        names = [r["name"] for r in given.withColumn("name", enforce_repo_prefix(F.col("name"), F.col("repo"))).orderBy("i").collect()]
    kept = projects.join(match.select(F.col("project").alias("id")), "id", "left_semi")
    final = graph.unique_names([r["name"] for r in kept.select("name").collect()], names or [r["plain"] for r in rows])
    made = spark.createDataFrame([(r["component"], n) for r, n in zip(rows, final, strict=True)], f"component {notes.schema['id'].dataType.simpleString()}, name string").withColumn("id", F.sha2(F.concat_ws("\0", F.lit(now), F.col("component").cast("string")), 256))
    owner = match.join(made.select("component", F.col("id").alias("fresh")), "component", "left").select("component", F.coalesce("project", "fresh").alias("owner"))
    owned = component.join(owner, "component").select("id", "owner")
    updated = notes.join(owned, "id", "left").withColumn("project_id", F.col("owner")).select(notes.columns)
    return Outcome(stored_links, updated, kept.unionByName(made.select("id", "name", F.lit(now).alias("created_at"))), False)
