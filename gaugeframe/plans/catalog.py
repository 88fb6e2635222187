"""Every registered query of the audit engine with its SQL."""

from __future__ import annotations

from gaugeframe.plans import evidence_queries, metric_queries, model_queries, prepare_queries, protocol_queries  # noqa: F401
from gaugeframe.plans.registry import QUERIES, SQL


def flagship(spark, sf_dir: str):
    return QUERIES["protocol_test_metrics"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
