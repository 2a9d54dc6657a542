"""The full query catalogue: importing this module registers every query."""

from __future__ import annotations

from insight.plans import accounts, cleaning, customers, documents, operations, reports, risk, sales  # noqa: F401
from insight.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "rfm_segment_summary"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
