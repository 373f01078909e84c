"""Named queries over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from hyperloom.plans import checks, collision, questionnaire, rules, storage

PLANS = (collision, questionnaire, checks, storage, rules)


def queries() -> dict:
    return {k: f for plan in PLANS for k, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for plan in PLANS for k, s in plan.ORACLE.items()}
