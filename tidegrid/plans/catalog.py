"""Importing the query modules fills the registry."""

from tidegrid.plans import inputs  # noqa: F401
from tidegrid.plans import (  # noqa: F401
    queries_analytics,
    queries_eval,
    queries_features,
    queries_forecast,
    queries_grid,
    queries_sources,
    queries_streaming,
)
from tidegrid.plans.registry import QUERIES, resolved_checks

ORACLES = resolved_checks()

__all__ = ["ORACLES", "QUERIES"]
