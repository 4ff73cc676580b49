"""Every query that SQL can express, against that SQL."""

from __future__ import annotations

import pytest

from oracle import AT, assert_same_rows
from planloom import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same_rows(spark, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", ["document_rules", "rule_extract", "name_pairs", "action_targets"])
def test_runs(spark, name):
    rows = catalogue.queries()[name](spark, AT).collect()
    assert rows
    if name == "document_rules":
        assert all(2 <= len(r.title.split()) <= 3 and 5 <= len(r.description.split()) <= 7 for r in rows)
