"""All queries over the bar engine by name, each with SQL for the same rows where SQL can express it."""

from .queries import base, plans, series, signals

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "plans", "series", "signals"]
