"""All registered catalog queries and their SQL."""

from __future__ import annotations

from . import feeds, functions, ingest, matching, operations, prices  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
