"""The query catalogue: every query with, where SQL can state it, its SQL."""

from __future__ import annotations

from . import q_activity, q_corpus, q_facts, q_feeds, q_functions, q_ledger, q_retrieval, q_review, q_sources, q_streams, q_upkeep  # noqa: F401  (registration)
from .registry import QUERIES, SQL, QueryFn


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
