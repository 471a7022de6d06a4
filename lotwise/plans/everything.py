"""All registered queries."""

from lotwise.plans import function_queries, linkage_queries, search_queries, source_queries, state_queries  # noqa: F401
from lotwise.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
