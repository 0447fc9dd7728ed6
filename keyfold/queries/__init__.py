"""Named queries over the test tables, each with the same in SQL where SQL can express it."""

from keyfold.queries.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
