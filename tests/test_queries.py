from __future__ import annotations

import pytest

from sessionlake.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_says_what_its_sql_says(spark, data, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], data)


def test_chunks_are_lossless_and_within_budget(spark, data):
    found = catalog.QUERIES["chunk_sizes"](spark, data).collect()
    assert found and all(r["lossless"] and r["longest"] <= 2000 for r in found)


@pytest.mark.parametrize("name", ["louvain_clusters", "louvain_by_joins"])
def test_louvain_covers_every_node_once(spark, data, name):
    found = catalog.QUERIES[name](spark, data).collect()
    assert len({r["id"] for r in found}) == len(found) == 500
    assert sum(1 for r in found if r["cluster"] == 0) == max(r["size"] for r in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "id", "similarity", "via"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
