"""Registered queries; importing this package fills the registry."""

from webgrain.plans import (  # noqa: F401
    compliance_queries,
    log_queries,
    page_queries,
    record_queries,
    scalar_queries,
    url_queries,
)
from webgrain.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
