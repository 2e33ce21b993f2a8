"""Every core query against its SQL oracle, over whole tables."""

from __future__ import annotations

import pytest

from corvane.plans import registry
from tests.comparing import oracle_rows, rows_of, views


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    columns, rows = rows_of(registry.queries()[name](spark, sf_dir))
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    assert (columns, rows) == oracle_rows(con, sql)
