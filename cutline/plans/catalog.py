"""Every query over the driver's tables that isn't part of ``llm``, with its SQL."""

from __future__ import annotations

from . import decisions, files, records, relational, texts  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
