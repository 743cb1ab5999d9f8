"""Every query of the engine over the test tables, with its SQL."""

from __future__ import annotations

from quillgraph.plans import eval_queries, feed_queries, graph_queries, store_queries, text_queries

PARTS = (graph_queries.query, text_queries.query, eval_queries.query, store_queries.query, feed_queries.query)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.sql.items()}
