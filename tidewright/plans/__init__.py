"""Queries over the test tables, each with SQL that gives the same rows where SQL can."""

from tidewright.plans import core_queries, feature_queries, more_queries, regime_queries  # noqa: F401  they register themselves
from tidewright.plans.core_queries import flagship
from tidewright.plans.registry import ORACLES, QUERIES

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
