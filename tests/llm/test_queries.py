"""The operators' queries that SQL can express, against that SQL."""

from __future__ import annotations

import pytest

from oracle import assert_same_rows
from planloom.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same_rows(spark, registry.queries()[name], SQL[name])
