"""All registered queries."""

from __future__ import annotations

from . import mix_queries, rollout_queries, row_queries, rule_queries, source_queries, stream_queries, token_queries
from .views import Query

QUERIES: dict[str, Query] = {
    **row_queries.QUERIES,
    **rollout_queries.QUERIES,
    **mix_queries.QUERIES,
    **token_queries.QUERIES,
    **rule_queries.QUERIES,
    **stream_queries.QUERIES,
    **source_queries.QUERIES,
}
