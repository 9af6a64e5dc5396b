"""Queries over the given tables, each next to the SQL that must give the same rows."""

from . import checks, conform, mart, profile, quality, sources  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
