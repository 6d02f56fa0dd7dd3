"""What the operators of this folder share: reading columns safely, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and on a cluster an error."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_kinds(df: DataFrame, name: str, kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    """The same for rows of several ``kind``, each of which is read back as a table of its own; one without rows is empty."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    schema = StructType([f for f in df.schema if f.name != "kind"])
    written = {k: hadoop_path(spark, f"{path}/kind={k}") for k in kinds}
    return {
        k: (spark.read.schema(schema).parquet(folder.toString()) if system.exists(folder) else spark.createDataFrame([], schema)).withColumn("kind", F.lit(k))
        for k, (system, folder) in written.items()
    }


def hadoop_path(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialize` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        system, path = hadoop_path(df.sparkSession, folder)
        system.delete(path, True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that shuffles, sorts and merges, whatever size Spark takes its sides to have.

    Spark knows a table by its compressed files, and does not count the rows that an explode makes of them. So it may take a table of
    hundreds of megabytes for one below its limit for broadcasts, and build it in the driver.
    """
    return df.hint("merge")


#: A key with one of so many rows is frequent; so there are at most as many such keys.
FREQUENT = 1000


def joined_by(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``keyed(*keys, n, …)`` but ``n``, the number of rows of a key, of which there are ``total``; null where it has none.

    Frequent keys, which are few by definition, are broadcast, so that their rows stay where they are; others meet by a shuffle.
    """
    frequent = F.col("n") * FREQUENT >= total
    values = [c for c in keyed.columns if c not in (*keys, "n")]
    found = rows.join(F.broadcast(keyed.filter(frequent).select(*keys, F.struct(*values).alias("_found"))), keys, "left")
    others = found.filter("_found IS NULL").drop("_found").join(merged(keyed.filter(~frequent).drop("n")), keys, "left")
    return others.unionByName(found.filter("_found IS NOT NULL").select(*rows.columns, "_found.*"))


def text_column(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches again, at most ``rows`` long, so that what is made per batch stays small whatever the texts' lengths."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
