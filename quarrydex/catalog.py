"""All queries of the engine by name, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from .plans import path_queries, source_queries, store_queries, text_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
