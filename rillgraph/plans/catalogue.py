"""The named queries and their SQL."""

from __future__ import annotations

from rillgraph.plans import goal_queries, graph_queries, learning_queries, lookup_queries, report_queries, state_queries, stream_queries, text_queries, user_queries  # noqa: F401  each registers its queries

QUERIES: dict = dict(graph_queries.QUERIES)
ORACLES: dict = dict(graph_queries.ORACLES)
