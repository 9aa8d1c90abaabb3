"""The findings sink: a second write changes nothing."""

from auditlake.sources import sinks
from auditlake.streaming import progress as P

KIND = "review_id string, arrival_seq long, title string"


def stored(spark, path):
    return sorted((str(r.review_id), r.arrival_seq, r.title) for r in spark.read.parquet(path).collect())


def test_a_retry_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    names = [f"r{i}" for i in range(600)]  # several reviews a bucket
    first = spark.createDataFrame([(n, i, "old") for i, n in enumerate(names)] + [(None, 900, "old")], KIND)
    sinks.save_findings(first, path)
    once = stored(spark, path)
    assert len(once) == 601
    sinks.save_findings(first, path)
    assert stored(spark, path) == once
    new = spark.createDataFrame([("r5", 5, "new"), ("r5", 6, "new"), ("z", 7, "new"), (None, 8, "new")], KIND)
    want = sorted([x for x in once if x[0] not in ("r5", "None")] + [("r5", 5, "new"), ("r5", 6, "new"), ("z", 7, "new"), ("None", 8, "new")])
    for _ in range(2):
        sinks.save_findings(new, path)
        assert stored(spark, path) == want
    sinks.save_findings(first.limit(0), path)
    assert stored(spark, path) == want


def test_a_replayed_micro_batch(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], KIND).write.parquet(str(tmp_path / "in"))
    for cp in ("one", "two"):  # a lost checkpoint sends the batch again
        q = P.run_batches(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), lambda df, n: sinks.save_findings(df, str(tmp_path / "f")), str(tmp_path / cp))
        assert q.awaitTermination(120)
    assert stored(spark, str(tmp_path / "f")) == [("a", 1, "x"), ("b", 2, "y")]


def test_a_broken_write_is_finished(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.save_findings(spark.createDataFrame([("a", 1, "x")], KIND), path)
    b = spark.read.parquet(path).first().bucket
    spark.createDataFrame([("a", 1, "x", b), ("late", 2, "y", b)], KIND + ", bucket int").write.parquet(f"{path}/_merged")
    sinks.save_findings(spark.createDataFrame([("a", 1, "x")], KIND), path)
    assert stored(spark, path) == [("a", 1, "x"), ("late", 2, "y")]
