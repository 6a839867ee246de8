"""All registered queries of the audit, and the DuckDB SQL of those that have it."""

from __future__ import annotations

from . import audit, decisive, oracle, queries, signals, winning

QUERIES = queries.QUERIES | audit.QUERIES | signals.QUERIES | decisive.QUERIES | winning.QUERIES
SQL = oracle.SQL | audit.SQL | signals.SQL | decisive.SQL | winning.SQL
