"""Which repository a working folder belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many levels below a root ``.git`` folders are looked for.
DEPTH = 4


def git_folders(spark: SparkSession, *roots: str, depth: int = DEPTH) -> DataFrame:
    """(path) of the folders in and below the roots that hold a ``.git`` folder, which is told by its ``HEAD``; a ``.git`` file has none.

    Names alone are listed, wherever Spark can list.
    """
    found = spark.createDataFrame([], "path string")
    for root in roots:
        for level in range(depth + 1):
            try:
                heads = spark.read.format("binaryFile").load(root.rstrip("/") + "/*" * level + "/.git/HEAD").select("path")
            except Exception as e:  # no repository on this level
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            found = found.unionByName(heads)
    return found.select(F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/\\.git/HEAD$", "").alias("path")).distinct()


def segments(path: Column) -> Column:
    """The segments of an absolute path, without empty ones and ``.``; ``..`` takes away the one before."""
    step = lambda kept, s: F.when(s.isin("", "."), kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def with_repo(turns: DataFrame, folders: DataFrame) -> DataFrame:
    """``turns`` with ``repo``: the lower-case name of the nearest of ``folders(path)`` that their ``cwd`` is in, or is itself.

    Null for a ``cwd`` that is null, relative, or in none, and in the file system's root, which has no name. Each distinct ``cwd`` is
    parted into itself and the folders above, which are joined with ``folders``; so none is compared with all of them.
    """
    turns = turns.drop("repo")
    parts = turns.select("cwd").filter(F.col("cwd").startswith("/")).distinct().withColumn("_parts", segments(F.col("cwd")))
    above = parts.select("cwd", "_parts", F.explode(F.sequence(F.lit(0), F.size("_parts"))).alias("_n")).withColumn("_path", F.array_join(F.slice("_parts", 1, F.col("_n")), "/"))
    held = folders.filter(F.col("path").startswith("/")).select(F.array_join(segments(F.col("path")), "/").alias("_path")).distinct()
    nearest = above.join(held, "_path").groupBy("cwd").agg(F.max(F.struct("_n", F.col("_parts"))).alias("_at"))
    named = nearest.select("cwd", F.lower(F.try_element_at("_at._parts", F.nullif("_at._n", F.lit(0)))).alias("repo"))
    return turns.join(named, "cwd", "left")
