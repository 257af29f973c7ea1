"""All registered queries of the core, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from . import filequeries, problems, refqueries

MODULES = [problems, refqueries, filequeries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
