"""All registered queries of the library."""

from __future__ import annotations

from deskwise.plans import analytics, ingestion, retrieval, states, streams, texts  # noqa: F401
from deskwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
