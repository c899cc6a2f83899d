"""Queries over the star schema and the events."""

from quarrystone.plans import counts, relational, timelines
from quarrystone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "counts", "relational", "timelines"]
