"""Operators bound to the test tables."""

from . import further, ordered, relational, remaining, resolution, series, streams, textual  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
