"""Operators for building training data from text: extraction, removal of repeats, filters, tokens, packing, search."""

from cohortflow.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
