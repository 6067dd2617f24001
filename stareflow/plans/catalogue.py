"""All queries of the citation engine by name, with the SQL that checks them."""

from __future__ import annotations

from stareflow.plans import drafts, evaluation, filings, library, matching, rulings, search, texts

_PLANS = (rulings, library, matching, search, texts, filings, drafts, evaluation)

QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
