"""Registered queries and the SQL they are checked against."""

from corpusloom.plans import corpus, runs, sampling, stream
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "runs", "sampling", "stream"]
