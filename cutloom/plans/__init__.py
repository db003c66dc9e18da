"""Registered queries with their SQL."""

from cutloom.plans import assembly, balancing, details, edges, folds, further, growing, media, more, reflowing, reports, speech, studio, teasing, timelines  # noqa: F401  they register their queries
from cutloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
