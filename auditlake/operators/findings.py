"""Findings: normalised, united, deduplicated, ranked, counted, scored, routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.scalars import SEVERITIES, in_domain, score_tenths, severity_weight

# The order in which producers' findings are united, and the routes of signals (two under the tables' names as well).
PRODUCERS = ["style", "security", "architecture", "performance", "refactor"]
ROUTES = [
    ("architecture", "dependency_direction", "security", "focus_area"),
    ("architecture", "coupling", "performance", "focus_area"),
    ("architecture", "cyclic_dependency", "security", "focus_area"),
    ("architecture", "tight_coupling", "performance", "focus_area"),
    ("architecture", "interface_design", "refactor", "suspected_issue"),
    ("security", "sql_injection", "refactor", "suspected_issue"),
    ("security", "hardcoded_secret", "refactor", "suspected_issue"),
    ("performance", "complexity", "refactor", "focus_area"),
    ("performance", "nested_loop", "architecture", "context_hint"),
    ("refactor", "long_parameter_list", "style", "focus_area"),
]
SIGNAL_CAP = 10


def normalized(df: DataFrame) -> DataFrame:
    """Falsy values become nulls or defaults: an empty path, a line of 0, a missing severity or category."""
    return df.select(
        "review_id", "arrival_seq", "agent_type", F.coalesce(F.lower("severity"), F.lit("info")).alias("severity"), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("unknown")).alias("file_path"),
        F.nullif("line_start", F.lit(0)).alias("line_start"), F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category"), F.coalesce("title", F.lit("")).alias("title"),
    )


def producer_rank() -> Column:
    collaborative = F.col("triggered_by").isNotNull()
    own = F.coalesce(F.array_position(F.array(*map(F.lit, PRODUCERS)), F.col("agent_type")), F.lit(0))
    return F.when(collaborative, F.lit(len(PRODUCERS) + 1)).when(own > 0, own).otherwise(F.lit(len(PRODUCERS) + 2))


def united(df: DataFrame) -> DataFrame:
    """(review_id, position, arrival_seq): findings in the order of their producers, then of arrival."""
    w = Window.partitionBy("review_id").orderBy("rank", "arrival_seq")
    return df.select("review_id", "arrival_seq", producer_rank().alias("rank")).select("review_id", F.row_number().over(w).alias("position"), "arrival_seq")


def place_key() -> Column:
    """What, with path and category, makes two findings one: the line, or the title's first 60 characters where the line is unknown."""
    line = F.coalesce("line_start", F.lit(0))
    return F.when(line == 0, F.concat(F.lit("t:"), F.left(F.coalesce("title", F.lit("")), F.lit(60)))).otherwise(F.concat(F.lit("l:"), line.cast("string")))


def kept(df: DataFrame) -> DataFrame:
    """(review_id, arrival_seq, n_merged): the first finding of each place, by partial aggregation."""
    g = df.groupBy("review_id", "file_path", "category", place_key().alias("place"))
    return g.agg(F.min("arrival_seq").alias("arrival_seq"), F.count("*").alias("n_merged")).select("review_id", "arrival_seq", "n_merged")


def deduplicated(df: DataFrame, cols: list[str]) -> DataFrame:
    """The kept findings with the columns, in one aggregation."""
    best = F.min_by(F.struct("arrival_seq", *cols), "arrival_seq").alias("_r")
    out = df.groupBy("review_id", F.col("file_path").alias("_p"), F.col("category").alias("_c"), place_key().alias("_k")).agg(best)
    return out.select("review_id", "_r.arrival_seq", *[f"_r.{c}" for c in cols])


def ranked(df: DataFrame) -> DataFrame:
    """(review_id, rank_no, arrival_seq, weight): by severity, stable."""
    w = Window.partitionBy("review_id").orderBy(F.desc("weight"), "arrival_seq")
    return df.select("review_id", "arrival_seq", severity_weight(F.col("severity")).alias("weight")).select("review_id", F.row_number().over(w).alias("rank_no"), "arrival_seq", "weight")


def bucket_counts(df: DataFrame, unknown_as_info: bool = True) -> DataFrame:
    """One row per review with a count per severity, zero-filled; the case of a severity isn't levelled here."""
    known = in_domain(F.col("severity"))
    cols = []
    for s in SEVERITIES:
        hit = F.col("severity") == s
        if s == "info" and unknown_as_info:
            hit = hit | ~known
        cols.append(F.count_if(F.coalesce(hit, F.lit(False))).alias(s))
    return df.groupBy("review_id").agg(*cols)


def scored(df: DataFrame) -> DataFrame:
    """(review_id, critical, high, medium, low, score): of the deduplicated findings, a decimal with halves rounded up."""
    counts = bucket_counts(deduplicated(df, ["severity"]))
    tenths = score_tenths(F.col("critical"), F.col("high"), F.col("medium"), F.col("low"))
    return counts.select("review_id", "critical", "high", "medium", "low", (tenths.cast("decimal(10,1)") / F.lit(10)).cast("decimal(4,1)").alias("score"))


def score_python_compat(raw: Column) -> Column:
    """The binary rounding of Python, for parity bit by bit."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def rounded(s):
        return s.map(lambda x: round(x, 1))

    return rounded(raw)


def routes(spark: SparkSession) -> DataFrame:
    """The routing rules: a fixed handful of rows."""
    return spark.createDataFrame(ROUTES, "agent_type string, category string, target_agent string, signal_type string")


def signals(df: DataFrame) -> DataFrame:
    """(review_id, arrival_seq, source_agent, target_agent, signal_type, file_path, seq): severe findings with a route, at most ten of a review's agent."""
    severe = df.where(F.lower("severity").isin("critical", "high")).select("review_id", "arrival_seq", "agent_type", "category", "file_path")
    met = severe.join(F.broadcast(routes(df.sparkSession)), ["agent_type", "category"])
    w = Window.partitionBy("review_id", "agent_type").orderBy("arrival_seq")
    return met.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= SIGNAL_CAP).select("review_id", "arrival_seq", F.col("agent_type").alias("source_agent"), "target_agent", "signal_type", "file_path", "seq")


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int, name: str = "pos") -> DataFrame:
    """The first n rows of each key, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)
