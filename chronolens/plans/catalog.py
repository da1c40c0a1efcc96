"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import event_queries, group_queries, metric_queries, model_queries, packet_queries, price_queries

_PARTS = (metric_queries, event_queries, price_queries, model_queries, group_queries, packet_queries)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
