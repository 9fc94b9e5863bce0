"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("ingest", "retrieval", "understanding", "conversations", "evaluation", "streams", "ask")


def _registries():
    return [import_module(f"askgrid.workload.{topic}").R for topic in TOPICS]


def all_queries() -> dict:
    return {name: fn for r in _registries() for name, fn in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.sql.items()}
