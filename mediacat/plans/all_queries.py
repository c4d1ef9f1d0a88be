"""Importing this module registers every query."""

from mediacat.plans import (  # noqa: F401
    queries_archives, queries_content, queries_linking, queries_reports, queries_rescan,
)
from mediacat.plans.registry import QUERIES, SQL  # noqa: F401
