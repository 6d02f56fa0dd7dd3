"""All queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from sessionlake.plans import memory, records, retrieval

QUERIES = {**retrieval.QUERIES, **memory.QUERIES, **records.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **memory.ORACLE_SQL, **records.ORACLE_SQL}
