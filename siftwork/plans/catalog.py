"""Registry of every plan over the driver tables and its oracle SQL."""

from __future__ import annotations

from . import (audit_plans, eval_plans, extra_plans, hybrid_plans, norm_plans, quality_plans, report_plans,
               scale_plans, vector_plans, workflow_plans)

_MODULES = [vector_plans, hybrid_plans, eval_plans, norm_plans, report_plans, quality_plans,
            extra_plans, audit_plans, scale_plans, workflow_plans]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
