"""Name -> query and name -> DuckDB oracle of the engine's own operators."""

from __future__ import annotations

from .plans import certificate_queries, extraction_queries, item_queries, label_queries, party_queries, queries, sheet_queries, text_queries, training_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
