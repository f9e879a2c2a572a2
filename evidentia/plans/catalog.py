"""Queries by name and their DuckDB oracles."""

from __future__ import annotations

from evidentia.plans import detail_oracles, detail_queries, merge_oracles, merge_queries, text_oracles, text_queries  # noqa: F401  they register themselves
from evidentia.plans.oracles import ORACLES
from evidentia.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
