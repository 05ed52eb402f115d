"""Every operator as a query over the given tables."""

from millrace.queries import aggregates, checks, cleaning, extraction, health, ingest  # noqa: F401  (they register)
from millrace.queries.registry import QUERIES

__all__ = ["QUERIES"]
