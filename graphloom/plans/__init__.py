"""Registered driver queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import evaluation, html, knowledge, rules, sequences, similarity, streams, texts, typing  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
