"""Importing this module registers every query."""

from .base import ORACLE, QUERIES
from . import scans, filters, joins, aggregates, windows, texts, retrieval, graphs, lifecycle, streams  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
