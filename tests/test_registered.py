"""Every registered query against its SQL on the smallest tables."""

import pytest

from plotweave.registry import spark_queries, sql_queries
from tools.check import compare

QUERIES = spark_queries()
SQL = sql_queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, folder):
    frame = QUERIES[name](spark, folder)
    if name in SQL:
        problem, _ = compare(duck, frame, SQL[name])
        assert not problem
    else:
        assert frame.count() > 0


def test_entry_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
