"""Composed pipelines, the query catalog and the DuckDB oracle SQL."""
