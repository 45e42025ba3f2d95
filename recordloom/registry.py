"""All registered queries of the engine: name, function of (spark, sf_dir), and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from .operators import admin, beliefs, causal, concepts, health, insights, recall, service, texts

_ALL = (recall, insights, causal, beliefs, concepts, texts, health, admin, service)
QUERIES: dict = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for m in _ALL for k, sql in m.ORACLE_SQL.items()}
