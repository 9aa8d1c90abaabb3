"""The registry of named queries, each with its SQL where SQL can express it, and the shared common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.records import latest
from auditlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: One record per key, in SQL.
F_ = "f AS (SELECT * FROM agent_results QUALIFY row_number() OVER (PARTITION BY arrival_seq ORDER BY ingested_at DESC) = 1)"
T_ = "t AS (SELECT * FROM review_tasks QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC) = 1)"
C_ = "c AS (SELECT * FROM code_files QUALIFY row_number() OVER (PARTITION BY review_id, file_seq ORDER BY fetched_at DESC) = 1)"
K_ = "k AS (SELECT * FROM semantic_memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)"
E_ = "e AS (SELECT * FROM episodic_memories QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ingested_at DESC) = 1)"
WEIGHT = "CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
PLACE = "CASE WHEN coalesce(line_start, 0) = 0 THEN 't:' || left(coalesce(title, ''), 60) ELSE 'l:' || line_start::VARCHAR END"
LANG = "CASE lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.java' THEN 'java' ELSE 'unknown' END"


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def findings(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "agent_results"), ["arrival_seq"], "ingested_at", list(cols))


def tasks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "review_tasks"), ["review_id"], "updated_at", list(cols))


def files(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "code_files"), ["review_id", "file_seq"], "fetched_at", list(cols))


def knowledge(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "semantic_memories"), ["id"], "ts", list(cols))


def episodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "episodic_memories"), ["task_id"], "ingested_at", list(cols))


def long(*names: str):
    """Casts to long, for transform()."""
    return lambda df: df.withColumns({n: F.col(n).cast("long") for n in names})
