"""The relational query catalogue."""

from .plans import aggregates, basics, graphs, joins  # noqa: F401  they enter their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
