"""The registry of queries with their DuckDB counterparts."""
