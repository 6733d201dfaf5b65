"""Registered queries on the test tables, each with the SQL that must give the same rows."""

from checks import clinical_queries, cohort_queries, model_queries, profile_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
