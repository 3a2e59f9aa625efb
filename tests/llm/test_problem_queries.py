"""The subpackage's queries over the driver's tables."""

import pytest

from pkgloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0


def test_sql_names():
    assert set(SQL) <= set(QUERIES)
