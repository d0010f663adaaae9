"""Every query of the library by name, with its DuckDB oracle where SQL can express it."""

from lexmill.plans import correction, decisions, language, more, stores, typing
from lexmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "correction", "decisions", "language", "more", "stores", "typing"]
