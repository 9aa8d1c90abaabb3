import duckdb

from auditlake.operators import graph as G
from auditlake.plans import QUERIES, SQL


def test_cycles_of_six_and_components_beyond(spark):
    ring = lambda r, n: [(r, f"m{i}", f"m{(i + 1) % n}") for i in range(n)]
    rows = [*ring("five", 5), *ring("six", 6), *ring("nine", 9), ("nine", "m3", "m2"), ("nine", "m8", "x"), ("none", "a", "b"), ("none", "b", "b"), ("none", "a", "c")]
    got = {(r.review_id, r.kind, tuple(r.modules)) for r in G.cycle_report(spark.createDataFrame(rows, "review_id string, src string, dst string")).collect()}
    m = tuple(f"m{i}" for i in range(9))
    assert got == {("five", "cycle", m[:5]), ("six", "cycle", m[:6]), ("nine", "cycle", ("m2", "m3")), ("nine", "component", m)}


def test_import_cycles(spark, tmp_path):
    code = [("r", i, f"m{i}.py", f"import m{(i + 1) % n}\n", 1) for n in (7,) for i in range(n)] + [("q", i, f"m{i}.py", f"import m{(i + 1) % 5}\n", 1) for i in range(5)]
    spark.createDataFrame(code, "review_id string, file_seq int, path string, content string, fetched_at long").write.parquet(str(tmp_path / "code_files.parquet"))
    got = {tuple(r) for r in QUERIES["import_cycles"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW code_files AS SELECT * FROM read_parquet('{tmp_path}/code_files.parquet/*.parquet')")
    assert got == {("q", "cycle", "m0>m1>m2>m3>m4"), ("r", "component", "m0>m1>m2>m3>m4>m5>m6")} == set(con.execute(SQL["import_cycles"]).fetchall())
