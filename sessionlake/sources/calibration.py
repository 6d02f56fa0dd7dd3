"""The corpus that thresholds are calibrated on: lines of an id and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.text import js_trim
from sessionlake.operators.calibrate import MIN_NOTES


class CorpusError(ValueError):
    pass


def read_corpus(spark: SparkSession, path: str, least: int = MIN_NOTES) -> DataFrame:
    """(id, text): both strings, texts not blank, ids unique, at least ``least`` rows; anything else is an error."""
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))
    field = lambda name: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))
    rows = parsed.select(field("id").alias("id"), field("text").alias("text"))
    bad = F.col("id").isNull() | F.col("text").isNull() | (js_trim(F.col("text")) == "")
    n, wrong, ids = rows.agg(F.count("*"), F.count_if(bad), F.count_distinct("id")).first()
    if wrong or ids != n or n < least:
        raise CorpusError(f"{n} rows, {wrong} of them no id and text, {ids} ids; at least {least} are needed")
    return rows


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file's bytes, which pins measured thresholds to it."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()["d"]
