"""Registered queries over the test tables, each with its oracle text."""

from tandem.catalog import evaluation, prompts, relational, retrieval, sources  # noqa: F401
from tandem.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
