"""Registered queries and their SQL."""

from quire.plans import documents, edits, files, pagesets, reports  # noqa: F401
from quire.plans.catalog import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)
