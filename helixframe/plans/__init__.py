"""Registered queries."""

from helixframe.plans import filter_queries, function_queries, mapping_queries, pair_queries, set_queries, site_queries, structure_queries  # noqa: F401
from helixframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
