"""Order, rounding and unknown values, with a plain model of deduplication, ranking and score."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import findings as O
from auditlake.operators import records

SCHEMA = "review_id string, arrival_seq long, agent_type string, severity string, file_path string, line_start int, category string, title string"
WEIGHT = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def rows(n=400, seed=1):
    rng = random.Random(seed)
    sev = ["critical", "high", "medium", "low", "info", "HIGH", "odd", None]
    return [(f"r{rng.randrange(5)}", i, rng.choice(["style", "security", "performance", None]), rng.choice(sev), rng.choice(["a.py", "b.py", None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["x", "sql_injection", None]), rng.choice(["t" * 60 + "1", "t" * 60 + "2", "u", None])) for i in range(n)]


def test_against_model(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    kept = {}
    for r in data:
        place = ("t", (r[7] or "")[:60]) if not r[5] else ("l", r[5])
        kept.setdefault((r[0], r[4], r[6], place), r)
    assert {r.arrival_seq for r in O.kept(df).collect()} == {r[1] for r in kept.values()}
    counts = {}
    for r in kept.values():
        c = counts.setdefault(r[0], dict.fromkeys(["critical", "high", "medium", "low"], 0))
        if r[3] in c:
            c[r[3]] += 1
    for r in O.scored(df).collect():
        c = counts[r.review_id]
        raw = 10 - Decimal("0.5") * (2 * c["critical"] + c["high"] + Decimal("0.3") * c["medium"] + Decimal("0.1") * c["low"])
        assert r.score == max(Decimal(0), min(Decimal(10), raw)).quantize(Decimal("0.1"), ROUND_HALF_UP)
    order = {}
    for r in sorted(data, key=lambda r: (-WEIGHT.get((r[3] or "").lower(), 0), r[1])):
        order.setdefault(r[0], []).append(r[1])
    got = {}
    for r in O.ranked(df).orderBy("review_id", "rank_no").collect():
        got.setdefault(r.review_id, []).append(r.arrival_seq)
    assert got == order


def test_an_early_low_finding_masks_a_late_critical_one(spark):
    df = spark.createDataFrame([("r", 2, "a", "critical", "p", 3, "c", "x"), ("r", 1, "a", "low", "p", 3, "c", "y")], SCHEMA)
    assert [r.severity for r in O.deduplicated(df, ["severity"]).collect()] == ["low"]


def test_numbers_and_titles_never_collide(spark):
    df = spark.createDataFrame([("r", 1, "a", "low", "p", 3, "c", "x"), ("r", 2, "a", "low", "p", 0, "c", "3"), ("r", 3, "a", "low", "p", None, "c", "l:3")], SCHEMA)
    assert O.kept(df).count() == 3


def test_unknown_severities(spark):
    df = spark.createDataFrame([("r", 1, "a", s, "p", 1, "c", "x") for s in ("HIGH", None, "odd", "info", "low")], SCHEMA)
    assert O.bucket_counts(df).first().asDict() == {"review_id": "r", "critical": 0, "high": 0, "medium": 0, "low": 1, "info": 4}
    assert O.bucket_counts(df, unknown_as_info=False).first()["info"] == 1


def test_rounding(spark):
    x = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 3), (9, 9, 9, 9)], "c int, h int, m int, l int").select(S.score_tenths(*map(F.col, "chml")).alias("t"))
    assert [r.t for r in x.collect()] == [99, 100, 99, 0]
    y = spark.createDataFrame([(9.85,), (9.95,)], "x double").select(O.score_python_compat(F.col("x")).alias("y"))
    assert [r.y for r in y.collect()] == [9.8, 9.9]


def test_signal_cap(spark):
    df = spark.createDataFrame([("r", i, "security", "high", "p", 1, "sql_injection", "t") for i in range(25)] + [("r", 90, "security", "low", "p", 1, "sql_injection", "t"), ("r", 91, "style", "high", "p", 1, "naming", "t")], SCHEMA)
    assert [r.arrival_seq for r in O.signals(df).orderBy("seq").collect()] == list(range(10))


def test_latest_and_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 5), (1, "c", 2), (2, None, None)], "k int, v string, o int")
    assert {(r.k, r.v) for r in records.latest(df, ["k"], "o").collect()} == {(1, "b"), (2, None)}
    none = spark.createDataFrame([], SCHEMA)
    for f in (O.kept, O.ranked, O.bucket_counts, O.scored, O.signals):
        assert f(none).count() == 0


def test_scalars(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(S.html_escape(F.lit("<a href=\"x\">&'</a>")).alias("x")).x == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;"
    assert [r[0] for r in spark.createDataFrame([("your-key",), (None,), ("short",), ("abcdefghijk",)], "k string").select(S.masked_key(F.col("k"))).collect()] == ["(unset)", "(unset)", "........", "abcd...jk"]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("ab",), ("x" * 41,)], "t string").select(S.token_estimate(F.col("t"))).collect()] == [0, 0, 1, 10]
    assert [r[0] for r in spark.createDataFrame([(999,), (1000,), (1250,), (61949,)], "m long").select(S.duration_text(F.col("m"))).collect()] == ["999ms", "1.0s", "1.3s", "61.9s"]
    text = "a\r\nb\x0bc\u2028\n\nd\n"
    assert one(S.lines_of(F.lit(text)).alias("x")).x == text.splitlines()
    assert one(S.lines_of(F.lit("")).alias("x")).x == []
    m = spark.createDataFrame([("app/core/a.py", "python"), ("app/__init__.py", "python"), ("cmd/main.go", "go"), ("src\\x.tsx", "typescript"), ("./a.py", "python")], "p string, l string").select(S.module_of(F.col("p"), F.col("l")))
    assert [r[0] for r in m.collect()] == ["app.core.a", "app", "cmd.main", "src.x.tsx", "a"]
