"""Where results go: findings by review, upserts, reports, logs. Every sink may be written again without harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import html_escape


def save_findings(findings: DataFrame, path: str) -> None:
    """Findings by review bucket: a batch replaces the stored rows of its reviews, so a retry gives the same table; one writer at a time.

    The touched buckets are merged aside and then overwritten. A write that broke off between is finished by the next call first, so
    no rows of other reviews are lost. A review of which the batch has no finding keeps its rows.
    """
    spark = findings.sparkSession
    jvm = spark._jvm
    root, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}/_merged")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def put() -> None:
        spark.read.parquet(f"{path}/_merged").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        fs.delete(aside, True)

    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_merged/_SUCCESS")):
        put()
    x = findings.withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(256)).cast("int")).persist()
    try:
        touched = [r.bucket for r in x.select("bucket").distinct().collect()]
        if not touched:
            return
        merged = x
        if fs.exists(root) and any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(root)):
            own = x.select(F.col("review_id").alias("_own")).distinct()
            kept = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(own, F.col("review_id").eqNullSafe(F.col("_own")), "left_anti")
            merged = x.unionByName(kept, allowMissingColumns=True)
        merged.write.mode("overwrite").parquet(f"{path}/_merged")
        put()
    finally:
        x.unpersist()


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old table with the new rows in place of those of the same key; of nulls in a new row the old value stays."""
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key], F.lit(True).alias("_new"))
    both = old.join(n, key, "full")
    return both.select(*key, *[F.coalesce(f"_n_{c}", c).alias(c) if f"_n_{c}" in n.columns else F.col(c) for c in old.columns if c not in key])


def rewrite(df: DataFrame, path: str) -> None:
    """A whole store rewritten at once."""
    df.write.mode("overwrite").parquet(path)


def log_lines(df: DataFrame, level: str, message: Column, extras: list[str]) -> DataFrame:
    """JSON log lines with fixed fields and the extras that aren't null."""
    return df.select(F.to_json(F.struct(F.lit(level).alias("level"), message.alias("message"), *extras), {"ignoreNullFields": "true"}).alias("value"))


def score_colour(score: Column) -> Column:
    return F.when(score >= 8, "#2e7d32").when(score >= 6, "#f9a825").otherwise("#c62828")


def html_report(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, html): a page per review, of scores(review_id, score) and findings(review_id, arrival_seq, severity, title, file_path, line_start)."""
    cell = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    row = F.concat(F.lit("<tr><td>"), cell("severity"), F.lit("</td><td>"), cell("title"), F.lit("</td><td>"), cell("file_path"), F.lit(":"), cell("line_start"), F.lit("</td></tr>"))
    rows = findings.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("arrival_seq", row.alias("x")))).alias("r"))
    head = F.concat(F.lit("<html><body><h1>Review "), html_escape(F.col("review_id")), F.lit('</h1><p style="color:'), score_colour(F.col("score")), F.lit('">'), F.col("score").cast("string"), F.lit("</p><table>"))
    body = F.coalesce(F.array_join(F.transform("r", lambda r: r["x"]), ""), F.lit(""))
    return scores.join(rows, "review_id", "left").select("review_id", F.concat(head, body, F.lit("</table></body></html>")).alias("html"))


def change_summary(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """(review_id, body): a change request's summary, with a severity table; counts(review_id, critical, high, medium, low, info)."""
    mark = F.when(F.col("score") >= 8, "good").when(F.col("score") >= 6, "fair").otherwise("poor")
    table = F.concat_ws("\n", F.lit("| severity | n |"), F.lit("|---|---|"), *[F.concat(F.lit(f"| {s} | "), F.coalesce(F.col(s), F.lit(0)).cast("string"), F.lit(" |")) for s in ("critical", "high", "medium", "low", "info")])
    return scores.join(counts, "review_id", "left").select("review_id", F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit(" ("), mark, F.lit(")\n\n"), table).alias("body"))


def exported(markdown: Column, form: str) -> Column:
    """A report as Markdown, or wrapped as a page for printing; other forms are refused."""
    if form == "markdown":
        return markdown
    if form in ("html", "pdf"):
        return F.concat(F.lit("<html><body><pre>"), markdown, F.lit("</pre></body></html>"))
    raise ValueError(f"unknown form {form}")
