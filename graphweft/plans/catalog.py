"""All registered queries."""

from graphweft.plans import extract_queries, graph_queries, store_queries  # noqa: F401
from graphweft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
