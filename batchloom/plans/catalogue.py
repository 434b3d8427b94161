"""All queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from batchloom.plans import function_queries, lineage_queries, program_queries, state_queries, step_queries, summary_queries, text_queries  # noqa: F401  they register their queries
from batchloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
