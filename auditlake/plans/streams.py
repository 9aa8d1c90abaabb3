"""Batch twins of the progress stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.plans.base import query
from auditlake.session import table
from auditlake.streaming import progress as P


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def progress_last(spark, d):
    return P.last_progress(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value", "event_id"])


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best")
def progress_monotone(spark, d):
    return P.monotone(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS e FROM events) WHERE e IS NULL OR event_id <= e")
def until_terminal(spark, d):
    return P.until_terminal(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")
