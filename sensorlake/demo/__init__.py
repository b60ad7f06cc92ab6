"""Example queries over the given tables, each with the SQL that states the same result."""

from .registry import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
