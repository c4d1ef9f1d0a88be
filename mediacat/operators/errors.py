"""Kinds of failure and the categories they are stored under."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat import fixed


def error_category(kind: Column) -> Column:
    """Internal category of a failure kind."""
    found = None
    for name, category in fixed.ERROR_KINDS.items():
        found = F.when(kind == name, category) if found is None else found.when(kind == name, category)
    return found.otherwise(fixed.UNKNOWN_ERROR_KIND)


def stored_category(category: Column) -> Column:
    """One of the five categories the error table allows."""
    found = None
    for name, stored in fixed.STORED_CATEGORIES.items():
        found = F.when(category == name, stored) if found is None else found.when(category == name, stored)
    return found.otherwise(fixed.STORED_CATEGORIES[fixed.UNKNOWN_ERROR_KIND])
