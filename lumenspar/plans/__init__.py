"""Registered queries over the supplied tables."""

from lumenspar.plans import lexical_queries, log_queries, vector_queries  # noqa: F401
from lumenspar.plans.registry import ORACLE, QUERIES  # noqa: F401
