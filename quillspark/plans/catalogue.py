"""All named queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from . import aliases, answering, evaluation, ingest, rendered, retrieval, stored, traces  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
