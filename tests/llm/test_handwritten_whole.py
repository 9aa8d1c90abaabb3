"""The model comes from every record, however many there are."""

import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import handwritten as H
from tests.llm.test_handwritten import WORDS, corpus, hand, small

FILES, TASKS, LIBS = "review_id string, file_seq int, path string, content string", "review_id string, repo_url string, updated_at string", "lib_name string, home_url string, content string"


def test_kind_of_few_records(spark):
    rng = random.Random(3)
    hands = [(f"h{i}", i, f"src/{rng.choice(WORDS)}_{i}.js", hand(rng)) for i in range(6000)]
    keys = spark.range(60).select(F.concat(F.lit("m"), "id").alias("review_id"), F.col("id").cast("int").alias("file_seq"))
    undrawn = keys.where("pmod(xxhash64(review_id, file_seq, 'train'), 1000000) > 510000").limit(8).collect()  # a draw of half the keys leaves these out
    few = [(r.review_id, r.file_seq, f"src/{rng.choice(WORDS)}.js", small(rng)) for r in undrawn]
    files = spark.createDataFrame(hands + few, FILES)
    tasks = spark.createDataFrame([], TASKS)
    got = {r.review_id for r in H.not_handwritten(files, tasks, spark.createDataFrame([], LIBS)).collect()}
    assert len(few) == 8 and got == {r[0] for r in few}


def test_common_lines_of_all_texts(spark):
    lines = [f"shared_setting_number_{i} = load()" for i in range(40)]
    libs = H.Libraries.of([("tiny", "https://git.example/own/tiny", "\n".join(lines))])
    texts = [f"own_line_{i}_a = first()\nown_line_{i}_b = second()\n" + ("\n".join(lines[:1]) if i % 1000 < 2 else "") for i in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "record long, content string").withColumn("text", F.xxhash64("content"))
    n, common = H.common_lines(df.union(df.limit(50)), lambda: libs)
    assert n == 12000 and common == set(H.line_hashes(lines[:1]))  # 8 of 4,000 texts


def test_shards(spark, monkeypatch):
    rows, truth, libs = corpus()
    files = spark.createDataFrame([(a, b, c, t) for a, b, c, t, _ in rows], FILES)
    again = files.union(files.limit(90)).repartition(7)
    tasks = spark.createDataFrame([(a, r, "2025-01-01") for a, _, _, _, r in rows], TASKS)
    known = spark.createDataFrame(libs, LIBS)
    monkeypatch.setattr(H, "SHARD_ROWS", 150)
    monkeypatch.setattr(H, "FAN", 2)
    found, model = H.judged(files, tasks, known)
    got, want = {r.review_id for r in found.collect()}, {k for k, v in truth.items() if v}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    other = H.judged(again, tasks, known)[1]
    assert np.array_equal(model.weights, other.weights) and np.array_equal(model.bias, other.bias)
    assert set(model.held_out) == set(H.KINDS)
