"""Every query of the core with its SQL oracle."""

from __future__ import annotations

from talasik.plans import analytics, evaluation, intake, matching, normalise, tables, textops

_PLANS = (analytics, normalise, matching, evaluation, textops, tables, intake)
QUERIES = {k: v for m in _PLANS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PLANS for k, v in m.SQL.items()}
