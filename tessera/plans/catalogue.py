"""All registered queries of the engine's own operators."""

from __future__ import annotations

from tessera.plans import module_queries, more_queries, observer_queries, payload_queries, processor_queries, prompt_queries, ranking_queries, relational_queries, search_queries, stage_queries, store_queries, text_queries  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
