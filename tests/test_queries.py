"""Every registered query of the library, against DuckDB where SQL can express it."""

import pytest

from deskwise.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    found = QUERIES[name](spark, small)
    if name in ORACLES:
        assert_same(found.collect(), found.columns, duck(small).sql(ORACLES[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r["status"] for r in entry.entry(spark).collect()} <= {"answered", "document_added", "no_status", "not_official", "unanswered"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
