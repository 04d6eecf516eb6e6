"""All registered queries. Importing the modules registers them."""

from daywatch.plans.catalog import (  # noqa: F401
    channel_queries,
    detect_queries,
    layer_queries,
    model_queries,
    risk_queries,
    serving_queries,
)
from daywatch.plans.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
