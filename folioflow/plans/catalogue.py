"""Queries of the core library by name, and the SQL they are compared with."""

from __future__ import annotations

from folioflow.operators import content, details, extras, layout, selection, state, timestamps
from folioflow.plans import documents
from folioflow.sources import http, store
from folioflow.streaming import carry_over, gestures, reader

_MODULES = (selection, content, state, details, extras, documents, layout, carry_over, gestures, reader, http, store)

QUERIES = {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()} | {
    "p6_found": timestamps.p6_found,
    "p6_estimated": timestamps.p6_estimated,
    "p6_zone_estimates": timestamps.p6_zone_estimates,
}

ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
