"""All queries by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from millrace.plans import columns_q, gates_q, reports_q, surface_q, windows_q  # noqa: F401  they register their queries
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
