"""Redelivered rows and reducers: one record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str, cols: list[str] | None = None) -> DataFrame:
    """The row of each key with the largest ``order`` (null is smallest), by partial aggregation rather than a window."""
    rest = [c for c in (cols or df.columns) if c not in keys]
    picked = df.select(*dict.fromkeys([*keys, *rest, order]))
    best = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order)).alias("_r")
    return picked.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_value(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The last-value reducer: what was written last wins."""
    return df.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def merged_maps(df: DataFrame, key: str, field: str, value: str, seq: str) -> DataFrame:
    """The map-merge reducer, one row per field: the right side wins."""
    return last_value(df, [key, field], value, seq)
