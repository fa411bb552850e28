"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from compare import assert_same

from ledgerloom import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert_same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
