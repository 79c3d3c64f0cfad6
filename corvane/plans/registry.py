"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import edges, evaluation, extra, index, more, parsing, problems, similarity, streams

MODULES = [problems, similarity, edges, index, evaluation, parsing, streams, more, extra]


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}
