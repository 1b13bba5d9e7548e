"""Queries over the engine's own operators, with their SQL twins."""

from __future__ import annotations

from rankloom.plans import evaluation_queries, ranking_queries, relational_queries, source_queries, text_queries, training_queries

_MODULES = (ranking_queries, relational_queries, text_queries, training_queries, source_queries, evaluation_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
