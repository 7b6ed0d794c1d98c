"""Each registered genotype query agrees with its SQL on an independent engine."""

from __future__ import annotations

import pytest

from locusframe.plans import all_queries
from tests.support import assert_same

REGISTRY = all_queries()


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert_same(REGISTRY.QUERIES[name](spark, sf), sf, REGISTRY.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    df = REGISTRY.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
