"""Every query of the core against DuckDB over whole tables, and the entry's contract."""

import importlib
import sys
from pathlib import Path

import pytest

from pkgloom.plans import registry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
compare = importlib.import_module("compare")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, folder, name):
    got, names = compare.spark_rows(registry.queries()[name](spark, folder))
    want, wanted = compare.duck_rows(compare.connect(folder), registry.oracle_sql()[name])
    assert names == wanted
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert df.columns and df.count() >= 0


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
