"""All registered queries of the engine's own operators."""

from __future__ import annotations

import importlib

from corpusloom.plans.registry import QUERIES, SQL

for _name in ("text_queries", "retrieval_queries", "corpus_queries", "ingest_queries", "graph_queries", "memory_queries", "analytics_queries", "streaming_queries"):
    importlib.import_module(f"corpusloom.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
