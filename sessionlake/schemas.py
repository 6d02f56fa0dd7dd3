"""Fixed schemas of the stored tables, and what must hold for their rows (Parquet has no constraints of its own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

SCHEMA_VERSION = "1"

_DDL = {
    "captures": "id string, site string, conversation_id string, conversation_title string, prompt string, response string, model string, metadata string, source_key string, captured_at string, created_at string, distilled_at string, seq long",
    "projects": "id string, name string, created_at string",
    "notes": "id string, site string, conversation_id string, conversation_title string, turn_count int, topic string, summary string, compacted_text string, entity_tags array<string>, repo_name string, project_id string, model_used string, first_captured_at string, last_captured_at string, distilled_at string",
    "links": "a string, b string, similarity double, computed_at string",
    "decisions": "id string, note_id string, decision_text string, reason string, topic string, content_hash string, source_summary string, provenance string, human_quote string, author string, origin string, ledger_path string, published_at string, decided_at string, created_at string",
    "decision_edges": "id string, decision_a string, decision_b string, edge_type string, confidence double, rationale string, status string, created_at string",
    "receipts": "id string, statement string, surfaced_ids array<string>, edge_id string, surfaced_at string, expires_at string, confirmed_at string, human_confirmation_quote string",
    "jobs": "id string, kind string, payload string, status string, attempts int, epoch int, last_error string, run_after string, lease_until string, created_at string, updated_at string, seq long",
    "note_vec": "id string, embedding array<float>",
    "decision_vec": "id string, embedding array<float>",
}
_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "array<string>": ArrayType(StringType()), "array<float>": ArrayType(FloatType())}
TABLES: dict[str, StructType] = {}
for _name, _ddl in _DDL.items():
    TABLES[_name] = StructType()
    for _field in _ddl.split(", "):
        TABLES[_name].add(_field.split(" ")[0], _TYPES[_field.split(" ")[1]])

#: Columns that hold a few words only.
ENUMS = {
    "decisions": {"provenance": ("distilled", "ratified"), "origin": ("local", "ledger")},
    "jobs": {"status": ("queued", "running", "done", "failed"), "kind": ("distill", "link-cluster", "reembed", "backfill", "backfill-page")},
}
#: Unique keys; where a condition is given, among the rows that meet it.
KEYS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "captures": [(("id",), "true"), (("site", "conversation_id", "source_key"), "true")],
    "projects": [(("id",), "true"), (("lower(name)",), "true")],
    "notes": [(("id",), "true"), (("site", "conversation_id"), "true")],
    "links": [(("a", "b"), "true")],
    "decisions": [(("id",), "true"), (("note_id", "content_hash"), "note_id IS NOT NULL"), (("content_hash",), "note_id IS NULL AND origin = 'local'")],
    "jobs": [(("id",), "true")],
    "note_vec": [(("id",), "true")],
    "decision_vec": [(("id",), "true")],
}


def valid_enums(name: str) -> Column:
    """Whether a row's enumerated columns hold allowed words."""
    ok = F.lit(True)
    for column, words in ENUMS.get(name, {}).items():
        ok = ok & F.coalesce(F.col(column).isin(*words), F.lit(False))
    return ok


def violations(name: str, df: DataFrame) -> DataFrame:
    """(rule, n): broken rules of table ``name`` and how many rows or keys break each; empty if all hold."""
    found = df.filter(~valid_enums(name)).agg(F.count("*").alias("n")).select(F.lit("enum").alias("rule"), "n")
    for key, condition in KEYS.get(name, []):
        twice = df.filter(condition).groupBy(*map(F.expr, key)).count().filter("count > 1").agg(F.count("*").alias("n"))
        found = found.unionByName(twice.select(F.lit(f"unique {', '.join(key)}").alias("rule"), "n"))
    if name == "links":
        found = found.unionByName(df.filter("NOT a < b").agg(F.count("*").alias("n")).select(F.lit("a < b").alias("rule"), "n"))
    return found.filter("n > 0")
