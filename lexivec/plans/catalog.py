"""Name -> builder and oracle SQL of every registered query."""

from __future__ import annotations

from lexivec.plans import clusters, corpus, files, labels, metrics, pretraining, relational, scoring, sequences, texts, vectors  # noqa: F401
from lexivec.plans.registry import QUERIES


def queries() -> dict:
    return {name: q.build for name, q in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
