"""The p-queries, their SQL twins where SQL can express them, and the order in which they are listed."""

from __future__ import annotations

from rankloom.llm import bpe, canonical, chosen_path, mixing, overlap, qdigest, stuffing, topn, truncation

_MODULES = (topn, canonical, chosen_path, overlap, bpe, stuffing, truncation, mixing, qdigest)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
