"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def contains_any(text: Column, terms: Column) -> Column:
    """Whether lower-cased `text` holds any of the (lower-case) `terms`."""
    low = F.lower(text)
    return F.exists(terms, lambda t: low.contains(t))
