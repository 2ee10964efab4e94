"""Queries that bind the operators to the given tables, with DuckDB equivalents."""

from . import certification_queries, estate_queries, generate_queries, masking_queries, metadata_queries, quality_queries, registry_queries, selection_queries, source_queries, streaming_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
