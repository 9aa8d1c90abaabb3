"""Queries on the functions of source files (no SQL can parse them; tests hold them against small fixtures)."""

from __future__ import annotations

from auditlake.operators import functions as O
from auditlake.plans.base import files, query
from auditlake.session import spread

_KEY = ["review_id", "file_seq"]


def _functions(spark, d):
    return O.functions_of(spread(files(spark, d, "path", "content")), _KEY)


@query()
def function_metrics(spark, d):
    return _functions(spark, d)


@query()
def function_length(spark, d):
    return O.length_findings(_functions(spark, d))


@query()
def cyclomatic_complexity(spark, d):
    return O.complexity_findings(_functions(spark, d))


@query()
def function_smells(spark, d):
    return O.smell_findings(_functions(spark, d))


@query()
def file_stats(spark, d):
    f = files(spark, d, "path", "content")
    return O.file_stats(f, O.functions_of(spread(f), _KEY), _KEY)
