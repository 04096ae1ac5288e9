"""All queries of the core, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from linkgraph.plans import general_queries, graph_queries, session_queries, text_queries

_MODULES = [graph_queries, text_queries, session_queries, general_queries]


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
