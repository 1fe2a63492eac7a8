"""Every query that SQL can express gives the rows of its SQL."""

import importlib.util

import pytest

from helpers import duck_rows, spark_rows
from quarry.plans.oracle import SQL
from quarry.plans.queries import QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_rows_equal_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(SQL[name], small)


def test_search_at_any_partition_count(spark):
    large, before, found = "/root/testdata/sf0.1", spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(spark_rows(QUERIES["search_modes"](spark, large)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0][1]) == 3000


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(QUERIES) <= set(found)
    assert set(entry.oracle_sql()) <= set(found)
    assert ("pipeline" in found) == bool(importlib.util.find_spec("quarry.llm") and importlib.util.find_spec("corpus_pipeline"))
    assert entry.entry(spark).columns[:3] == ["query_id", "mode", "rnk"]
