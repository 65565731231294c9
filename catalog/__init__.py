"""Test inputs, registered queries and their checks."""

from catalog import ingest_queries, page_queries, profile_queries, publish_queries, site_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
