import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from auditlake import plugins
from auditlake.sources import events, files, paged, sinks


def fetch_pages(name, page, size):
    rows = [(f"{name}{i}.py", "added", "+x") for i in range(25)]
    return rows[(page - 1) * size : page * size]


def test_files(spark, tmp_path):
    got = files.inline(spark, "r", [{"path": "a.py", "content": "x"}, {"path": " ", "content": "y"}, {"path": "b.py", "content": ""}]).collect()
    assert [(r.file_seq, r.path) for r in got] == [(0, "a.py")]
    for p, data in {"a.py": b"x = 1\n", "sub/b.GO": b"package b", "docs/c.py": b"no", "d.txt": b"no", "e.py": b"caf\xe9", "1/2/3/4/5/deep.py": b"no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    got = {r.path: r.content for r in files.folder(spark, str(tmp_path), "r").collect()}
    assert got == {"a.py": "x = 1\n", "sub/b.GO": "package b", "e.py": "caf\ufffd"}
    b = base64.encodebytes("é" .encode() * 100).decode()
    assert spark.createDataFrame([(b,)], "b string").select(files.from_base64(F.col("b")).alias("x")).first().x == "é" * 100


def test_changes(spark):
    c = spark.createDataFrame([("r", "a.py", "modified", "@@ -1 +1 @@\n-x\n+y"), ("r", "b.py", "removed", "-x"), ("r", "c.py", "added", None), ("r", "d.txt", "added", "+x"), ("r", "e.py", "added", None)], "review_id string, path string, status string, patch string")
    full = spark.createDataFrame([("r", "c.py", "whole")], "review_id string, path string, content string")
    assert {(r.path, r.content) for r in files.changed(c, full).collect()} == {("a.py", "y"), ("c.py", "whole")}
    req = spark.createDataFrame([("r", "c.py", "mine")], "review_id string, path string, content string")
    assert {(r.path, r.content) for r in files.merged(req, full).collect()} == {("c.py", "mine")}
    many = spark.range(51).select(F.lit("m").alias("review_id"), F.lit("x").alias("content"))
    assert [(r.accepted, r.reason) for r in files.within_limits(many).collect()] == [(False, "too many files")]


def test_events(spark):
    body = json.dumps({"action": "opened", "repository": {"full_name": "o/r"}, "pull_request": {"number": 7, "head": {"sha": "s"}, "base": {"ref": "main"}}})
    sig = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("pull_request", body, sig), ("ping", body, sig), ("pull_request", body.replace("opened", "closed"), sig), ("pull_request", "broken", "x"), ("pull_request", None, None)], "event string, body string, sig string")
    assert [(r.repo, r.number, r.branch) for r in events.pull_requests(df).collect()] == [("o/r", 7, "main")]
    assert [r.ok for r in df.select(events.signed(F.col("body"), F.col("sig"), "k").alias("ok")).collect()] == [True, True, False, False, False]
    m = json.dumps({"object_kind": "merge_request", "project": {"path_with_namespace": "g/p"}, "object_attributes": {"iid": 3, "action": "open", "target_branch": "main", "last_commit": {"id": "c"}}})
    assert [(r.repo, r.number, r.sha) for r in events.merge_requests(spark.createDataFrame([(m,), ("x",)], "body string")).collect()] == [("g/p", 3, "c")]


def test_paged(spark):
    spark.dataSource.register(paged.PagedListing)
    df = spark.read.format("paged").option("fetch", "tests.test_sources:fetch_pages").option("lists", "a,b").option("size", "10").load()
    assert df.count() == 50 and df.where("list = 'b'").count() == 25


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("r", 1, "high", "<t>", "a.py", 3), ("q", 2, "low", "u", None, None)], "review_id string, arrival_seq long, severity string, title string, file_path string, line_start int")
    sinks.save_findings(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, "c", "y"), (3, "d", None)}
    s = spark.createDataFrame([("r", 9.5), ("z", 1.0)], "review_id string, score double")
    html = {r.review_id: r.html for r in sinks.html_report(s, f).collect()}
    assert "&lt;t&gt;" in html["r"] and "#2e7d32" in html["r"] and "<table></table>" in html["z"]
    c = spark.createDataFrame([("r", 1, 2, 0, 0, 0)], "review_id string, critical int, high int, medium int, low int, info int")
    assert "| high | 2 |" in {r.review_id: r.body for r in sinks.change_summary(s, c).collect()}["r"]
    log = sinks.log_lines(f, "INFO", F.col("title"), ["file_path"]).collect()
    assert json.loads(log[0].value) == {"level": "INFO", "message": "<t>", "file_path": "a.py"}
    with pytest.raises(ValueError):
        sinks.exported(F.lit("x"), "docx")


def test_plugins(spark):
    r = plugins.Registry()
    ok = plugins.Detector("lines_over", lambda df: df.where("length(content) > 3").select("path"), "style", ("python",), ("style",), "Long lines")
    r.register(ok)
    r.register(plugins.Detector("broken", lambda df: df.select("no_such_column")))
    r.register(plugins.Detector("asleep", lambda df: df, ready=lambda: False))
    with pytest.raises(ValueError):
        r.register(ok)
    with pytest.raises(ValueError):
        r.register(plugins.Detector("Bad-Name", lambda df: df))
    df = spark.createDataFrame([("a.py", "long text"), ("b.py", "x")], "path string, content string")
    found, errors = plugins.run_many(r, ["lines_over", "broken", "asleep", "absent"], df)
    assert [(x.path, x.source, x.skill_name) for x in found.collect()] == [("a.py", "skill", "lines_over")]
    assert {x.skill_name for x in errors.collect()} == {"broken", "asleep", "absent"}
    assert [d.name for d in r.search(language="python", tags=("style",), text="LONG")] == ["lines_over"] and r.by_category("style") == [ok]
    assert plugins.run_pipeline(r, ["lines_over"], df).count() == 1 and r.unregister("broken") and r.names() == ["asleep", "lines_over"]
