import pandas as pd

from auditlake.streaming import progress as P


def test_monotone_stream(spark, tmp_path):
    rows = [("a", 1, 0.1, "parse", "running", None), ("a", 2, 0.05, "style", "running", "oops"), ("a", 3, 0.5, "merge", "running", None), ("a", 4, 0.5, "merge", "running", None), ("a", 5, 1.0, "done", "completed", None), ("a", 6, 1.0, "done", "completed", None), ("b", 1, 0.2, "parse", "running", None), ("b", 2, 0.1, "parse", "failed", "bad"), ("b", 3, 0.9, "x", "running", None)]
    src = tmp_path / "in"
    for i, part in enumerate((rows[:3] + rows[6:7], rows[3:6] + rows[7:])):
        df = pd.DataFrame(part, columns=["task_id", "s", "progress", "stage", "status", "error"])
        df["ts"] = pd.to_datetime("2025-01-01") + pd.to_timedelta(df.s, unit="s")
        spark.createDataFrame(df[["task_id", "ts", "progress", "stage", "status", "error"]], P.PROGRESS).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(P.PROGRESS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = P.monotone_stream(stream, ttl_ms=None).writeStream.format("memory").queryName("mono").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
        got = [(r.task_id, r.progress, r.status, r.error) for r in spark.sql("select * from mono order by task_id, ts").collect()]
    finally:
        q.stop()
    assert got == [("a", 0.1, "running", None), ("a", 0.5, "running", "oops"), ("a", 1.0, "completed", "oops"), ("b", 0.2, "running", None), ("b", 0.1, "failed", "bad")]


def test_batches_run_the_pipeline(spark, tmp_path):
    spark.createDataFrame([("r1",), ("r2",)], "review_id string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("review_id string").parquet(str(tmp_path / "in"))
    P.run_batches(stream, lambda df, n: seen.extend(r.review_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == ["r1", "r2"]


def test_twins(spark):
    df = spark.createDataFrame([("a", 1, 0.1, "run"), ("a", 2, 0.05, "run"), ("a", 3, 0.3, "end"), ("a", 4, 0.9, "run"), ("b", 1, None, "run")], "t string, s int, v double, st string")
    assert {(r.t, r.s) for r in P.monotone(df, "t", "s", "v").collect() if r.v is not None} == {("a", 1), ("a", 3), ("a", 4)}
    assert {(r.t, r.v) for r in P.last_progress(df, "t", "s", ["v"]).collect()} == {("a", 0.9), ("b", None)}
    assert {(r.t, r.s) for r in P.until_terminal(df, "t", "s", df.st == "end").collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}
