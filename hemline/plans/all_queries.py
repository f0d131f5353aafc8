"""Imports every query module, which fills the registry."""

from hemline.plans import (  # noqa: F401
    catalog_queries,
    evaluation_queries,
    feature_queries,
    flow_queries,
    neighbor_queries,
    profile_queries,
    sales_queries,
    scaling_queries,
    source_queries,
)
from hemline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
