"""Importing this module registers every query."""

from . import mixture_queries, quality_queries, rule_queries, statistics_queries, timeline_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
