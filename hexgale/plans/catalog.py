"""All registered queries."""

from hexgale.plans import (  # noqa: F401
    indicator_queries,
    model_queries,
    regime_queries,
    series_queries,
    source_queries,
    spatial_queries,
)
from hexgale.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
