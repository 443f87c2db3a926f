"""The registered queries of the library's own operators, and the SQL that checks them."""

from pagesift.plans import intake, queries

QUERIES = queries.QUERIES | intake.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | intake.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
