"""All registered queries of the temporal text engine, by name."""

from .plans import file_queries, queries, recursive_sql

QUERIES = {**queries.QUERIES, **file_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **recursive_sql.ORACLE_SQL, **file_queries.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]
