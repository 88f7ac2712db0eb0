"""All queries of the library and the DuckDB SQL for them."""

from __future__ import annotations

from foliospark.plans import corpus_queries, library_queries, log_queries, retrieval_queries, text_queries, tool_queries  # noqa: F401
from foliospark.plans.register import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_retrieve"
