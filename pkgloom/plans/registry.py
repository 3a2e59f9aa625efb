"""All queries of the core: name -> Spark callable, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pkgloom.plans import packed, records, relational, texts  # noqa: F401, records and texts add their queries to the same registry


def queries() -> dict:
    return {"p1_found": packed.p1_found} | relational.QUERIES


def oracle_sql() -> dict:
    return dict(relational.SQL)
