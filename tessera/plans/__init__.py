"""Registered queries over the driver tables, each beside the SQL that checks it."""

from __future__ import annotations

from tessera.plans import aggregates, evidence_loop, filters, graph, joins, misc, more, payloads, ranking, scalars
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "evidence_loop", "filters", "graph", "joins", "misc", "more", "payloads", "ranking", "scalars"]
