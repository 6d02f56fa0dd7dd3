"""The queries of this folder and, where SQL can say the same, that SQL."""

from __future__ import annotations

from sessionlake.llm import chat, divergence, imatch, media, mixing, packing, pitman_yor, prefixes, quality, secrets, simhash, suffixes, warc

MODULES = (secrets, imatch, packing, pitman_yor, simhash, warc, quality, chat, mixing, media, prefixes, suffixes, divergence)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
