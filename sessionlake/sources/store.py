"""Versioned Parquet tables under one manifest, whose replacement publishes all tables of a commit at once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sessionlake.schemas import SCHEMA_VERSION, TABLES, violations


class SchemaError(RuntimeError):
    pass


class Conflict(RuntimeError):
    """The manifest changed, or a claim was lost, before the commit."""


@dataclass
class Snapshot:
    """A manifest as it was when opened; readers keep to it."""

    revision: int
    tables: dict[str, str] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)


class Store:
    """The tables in ``root``, a folder that the driver can write the manifest to; table files are Spark's."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        if os.path.exists(self._manifest) and (v := self._read()["schema_version"]) != SCHEMA_VERSION:
            raise SchemaError(f"schema version {v}, not {SCHEMA_VERSION}")

    @property
    def _manifest(self) -> str:
        return os.path.join(self.root, "MANIFEST.json")

    def _read(self) -> dict:
        if not os.path.exists(self._manifest):
            return {"schema_version": SCHEMA_VERSION, "revision": 0, "tables": {}, "meta": {}}
        with open(self._manifest, encoding="utf-8") as f:
            return json.load(f)

    def open(self) -> Snapshot:
        m = self._read()
        return Snapshot(m["revision"], m["tables"], m["meta"])

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        """A table of a snapshot, by default of now; empty if it was never written."""
        path = (at or self.open()).tables.get(name)
        if path is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self.root, path))

    def commit(self, at: Snapshot, tables: dict[str, DataFrame], meta: dict[str, str] | None = None, fence=None, check: bool = True) -> Snapshot:
        """Write new versions of some tables and publish them, if nobody else did since ``at`` and ``fence()`` holds."""
        written = dict(at.tables)
        for name, df in tables.items():
            path = f"{name}/v={at.revision + 1}-{uuid.uuid4().hex[:8]}"
            schema = TABLES[name]
            df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema)).write.parquet(os.path.join(self.root, path))
            written[name] = path
            if check and (broken := violations(name, self.spark.read.schema(schema).parquet(os.path.join(self.root, path))).collect()):
                raise SchemaError(f"{name}: {[tuple(b) for b in broken]}")
        following = Snapshot(at.revision + 1, written, at.meta | (meta or {}))
        lock = os.open(os.path.join(self.root, f".commit-{following.revision}"), os.O_CREAT | os.O_WRONLY)
        try:
            import fcntl

            fcntl.flock(lock, fcntl.LOCK_EX)
            if self._read()["revision"] != at.revision or (fence is not None and not fence()):
                raise Conflict(f"revision {at.revision} is not the latest, or the claim is lost")
            with tempfile.NamedTemporaryFile("w", dir=self.root, delete=False, encoding="utf-8") as f:
                json.dump({"schema_version": SCHEMA_VERSION, "revision": following.revision, "tables": following.tables, "meta": following.meta}, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(f.name, self._manifest)
        finally:
            os.close(lock)
        return following
