"""Named queries with their SQL."""

from auditlake.plans import context, findings, functions, serving, streams, texts
from auditlake.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "context", "findings", "functions", "serving", "streams", "texts"]
