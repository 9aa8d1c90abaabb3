import random
import textwrap

from pyspark.sql import functions as F

from auditlake.operators import dependencies as D
from auditlake.operators import functions as U
from auditlake.operators import graph as G
from auditlake.operators import memory as M
from auditlake.operators import text as X

FILE = "id int, path string, content string"


def test_rules_on_samples(spark):
    code = 'key = 1\napi_key = "abcdef123456"\n# api_key = "abcdef123456"\nq = f"SELECT * FROM t WHERE id = {i}"\nval = os.getenv("API_KEY")\nos.system(f"rm {x}")\nname: str = "password = \'abcdefgh1\'"\n'
    df = spark.createDataFrame([(1, "a.py", code), (2, "a.go", "s := fmt.Sprintf(\"SELECT %s\", x)\n"), (3, "b.txt", code), (4, None, code), (5, "c.py", None)], FILE)
    got = {(r.id, r.line_no, r.category) for r in X.rule_hits(df, ["id"]).collect()}
    assert got == {(1, 2, "hardcoded_secret"), (1, 4, "sql_injection"), (1, 6, "command_injection"), (2, 1, "sql_injection")}


HITS = {
    "py-secret": ("a.py", 'api_key = "abcdef123456"', 'myapi_key = "abcdef123456"'),
    "py-command": ("a.py", "subprocess.run(cmd, shell=True)", "subprocess.run(cmd, shell=False)"),
    "py-deserialize": ("a.py", "yaml.load(f)", "yaml.load(f, Loader=yaml.SafeLoader)"),
    "py-sql": ("a.py", 'q = f"DROP TABLE {t}"', 'q = "SELECT 1"'),
    "go-secret": ("a.go", "password = `any thing goes`", "password = `short`"),
    "go-command": ("a.go", "exec.Command(fmt.Sprintf(x))", 'exec.Command("ls")'),
    "go-sql": ("a.go", 'fmt.Sprintf("DROP TABLE %s", t)', 'fmt.Sprintf("SELECT 1")'),
    "go-path": ("a.go", "os.OpenFile(req.Path)", "os.OpenFile(path)"),
    "js-secret": ("a.ts", "secretKey: 'abcdef123456'", "secretKey: 'abc'"),
    "js-command": ("a.js", "child_process.exec(`ls ${x}`)", "exec(a + b)"),
    "js-xss": ("a.tsx", "el.innerHTML = `<b>${x}`", "el.innerHTML = ''"),
    "js-sql": ("a.js", "db.query(`DELETE FROM t WHERE id=${x}`)", "db.query(`SELECT 1`)"),
    "java-secret": ("A.java", 'String password = "abcdef123456";', "String password = 'abcdef123456';"),
    "java-command": ("A.java", 'Runtime.getRuntime().exec("ls " + x)', 'Runtime.getRuntime().exec("ls")'),
    "java-sql": ("A.java", '"DROP TABLE " + name', '"DROP TABLE t"'),
    "java-deserialize": ("A.java", "new ObjectInputStream(in)", "new InputStream(in)"),
}


def test_every_rule_hits_and_misses(spark):
    rows = [(i, path, text) for i, (path, yes, no) in enumerate(HITS.values()) for text in (yes, no)]
    df = spark.createDataFrame([(2 * i + (text == list(HITS.values())[i][2]), path, text) for i, path, text in rows], FILE)
    assert {(r.id, r.rule_id) for r in X.rule_hits(df, ["id"]).collect()} == {(2 * i, rule) for i, rule in enumerate(HITS)}
    assert set(HITS) == {r[0] for r in X.RULES}


def test_the_first_sql_rule_counts(spark):
    df = spark.createDataFrame([(1, "a.py", 'c.execute(f"SELECT {x}")\nc.execute(f"{x}")\n# c.execute(f"{x}")\nq = "DELETE FROM t " + x'), (2, "a.go", "db.Query(fmt.Sprintf(x))"), (3, "A.java", 's.execute("x" + y)'), (4, "a.jsx", 'q = "UPDATE t" + x')], FILE)
    assert {(r.id, r.line_no, r.rule) for r in X.sql_hits(df, ["id"]).collect()} == {(1, 1, "f-string"), (1, 2, "execute"), (1, 4, "concatenation"), (2, 1, "Query of Sprintf"), (3, 1, "execute"), (4, 1, "concatenation")}


def test_imports_of_all_languages(spark):
    go = 'import "fmt"\nimport x "own/pkg"\nimport (\n\t"net/http"\n\ty "own/other"\n)\n'
    java = "import java.util.List;\n  import static own.Tool.go;\nimport own.pkg.*;\n"
    script = "import {\n a } from './lib/a'\nconst b = require( \"lodash\" )\n"
    df = spark.createDataFrame([(1, "a.go", go), (2, "A.java", java), (3, "a.ts", script)], FILE)
    assert [r.imported for r in X.go_imports(df, ["id"]).collect()] == ["fmt", "own/pkg", "net/http", "own/other"]
    assert [r.imported for r in X.java_imports(df, ["id"]).collect()] == ["java.util.List", "own.Tool.go"]
    assert [r.imported for r in X.script_imports(df, ["id"]).collect()] == ["./lib/a", "lodash"]
    x = spark.createDataFrame([("go", "own/pkg"), ("go", "net/http"), ("java", "java.util.List"), ("java", "own.Tool"), ("java", "org"), ("typescript", "./lib/a"), ("typescript", "../b"), ("javascript", "lodash/fp"), ("python", "numpy.linalg"), ("python", "own.x")], "l string, i string")
    assert [r[0] for r in x.select(G.resolved(F.col("i"), F.col("l"))).collect()] == ["own.pkg", None, None, "own.Tool", "org", "lib.a", "b", None, None, "own.x"]


def test_style(spark):
    df = spark.createDataFrame([(1, "a.py", "x" * 121 + "\ny = 1  \n\t a\n b\n\n   \n"), (2, "b.py", "\ta\n")], FILE)
    assert {(r.id, r.line_no, r.category) for r in X.style_hits(df, ["id"]).collect()} == {(1, 1, "line_too_long"), (1, 2, "trailing_whitespace"), (1, 0, "mixed_indent")}
    d = spark.createDataFrame([(1, "a.py", "def f():\n    x\nclass A:\n\n    y\ndef g():\n# c\nclass B:")], FILE)
    assert [r.line_no for r in X.missing_blank_lines(d, ["id"]).collect()] == [1]


def test_diff(spark):
    patch = "@@ -3,4 +5,5 @@ head\n a\n-b\n+c\n+d\n e\n@@ -20 +30 @@\n+x\n-y"
    df = spark.createDataFrame([(1, "a", patch)], FILE)
    got = {(r.line_no, r.kind, r.old_line, r.new_line) for r in X.diff_lines(df, ["id"]).collect()}
    assert got == {(3, "removed", 4, 0), (4, "added", 0, 6), (5, "added", 0, 7), (8, "added", 0, 30), (9, "removed", 20, 0)}
    assert df.select(X.rebuilt_from_patch(F.col("content")).alias("x")).first().x == "a\nc\nd\ne\nx"


def test_fixed_chunks(spark):
    rng = random.Random(2)
    text = "\n".join("x" * rng.randrange(0, 90) for _ in range(300))
    rows = X.fixed_chunks(spark.createDataFrame([(1, "a", text), (2, "b", ""), (3, "c", None)], FILE), ["id"], most=100).orderBy("chunk_no").collect()
    lines = text.split("\n")
    assert rows[0].start_line == 1 and rows[-1].end_line == len(lines)
    for a, b in zip(rows, rows[1:]):
        assert b.start_line == a.end_line + 1 and a.tokens <= 100
        assert a.tokens + max(1, len(lines[b.start_line - 1]) // 4) > 100


def test_functions(spark):
    py = textwrap.dedent("""
        class A:
            def f(self, a, b, *c, d=1, **e):
                if a and b or not c:
                    for x in c:
                        while x:
                            pass
                return 1

        async def g():
            pass
        """)
    go = "func (s *S) F(a int, b string) error {\n\tif a > 1 && b != \"{\" {\n\t\tfor {\n\t\t}\n\t}\n}\n"
    df = spark.createDataFrame([(1, "a.py", py), (2, "a.go", go), (3, "b.py", "def ("), (4, "x.js", "function f(a, b) { return a ? b : 1 }\nconst g = (x) => {\n  if (x) {}\n}\n")], FILE)
    got = {(r.id, r.name): r for r in U.functions_of(df, ["id"]).collect()}
    f = got[1, "f"]
    assert (f.n_params, f.n_named, f.nesting, f.complexity) == (5, 6, 3, 7) and f.n_lines == 6
    assert got[1, "g"].complexity == 1 and got[2, "F"].complexity == 4 and got[2, "F"].n_params == 2
    assert got[4, "f"].complexity == 2 and got[4, "g"].n_lines == 3 and (3, "") not in got
    long = "def f():\n" + "    x = 1\n" * 61 + "\n\ndef h(a, b, c, d, e, f):\n    pass\n"
    u = U.functions_of(spark.createDataFrame([(1, "a.py", long)], FILE), ["id"])
    assert [r.name for r in U.length_findings(u).collect()] == ["f"]
    assert [(r.name, r.severity) for r in U.smell_findings(u).collect()] == [("h", "medium")]
    s = U.file_stats(df, U.functions_of(df, ["id"]), ["id"]).where("id = 1").first()
    assert (s.n_classes, s.n_functions, s.n_lines) == (1, 2, py.count("\n") + 1)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (1, 1), (4, 1), (1, 2)], "src int, dst int")
    assert {tuple(r.cycle) for r in G.cycles(e, 4).collect()} == {(1, 2), (1, 2, 3)}
    m = spark.createDataFrame([("r", 1, "app.a"), ("r", 2, "app.b"), ("r", 3, "lib.b"), ("r", 4, "solo")], "review_id string, file_seq int, module string")
    i = spark.createDataFrame([("r", 1, "app.b"), ("r", 1, "b"), ("r", 1, "os.path"), ("r", 2, "remote"), ("r", 2, "app.b")], "review_id string, file_seq int, imported string").withColumn("language", F.lit("python"))
    got = {(r.src, r.dst, r.kind) for r in G.import_edges(m, i).collect()}
    assert got == {("app.a", "app.b", "exact"), ("app.a", "app.b", "simple"), ("app.b", "remote", "external")}
    assert {r.module for r in G.isolated(m, G.import_edges(m, i)).collect()} == {"lib.b", "solo"}


def test_memory(spark):
    t = spark.createDataFrame([(i, i // 2) for i in range(10)] + [(99, None)], "id int, ts int")
    assert sorted(r.id for r in M.retained(t, "ts", 3).collect()) == [6, 7, 8, 9]
    d = spark.createDataFrame([(1, "cache Cache cachecache"), (2, None), (3, "none"), (4, "a cache")], "id int, t string")
    assert [(r.id, r.hits) for r in M.keyword_hits(d, F.col("t"), ["cache"], 5, "id").collect()] == [(1, 4), (4, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0])], "id int, v array<float>")
    assert [(r.id, r.similarity) for r in M.most_similar(v, "id", "v", [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.707107)]


def test_dependencies(spark):
    df = spark.createDataFrame([(1, "requirements.txt", "flask==1.0  # web\nFlask>=2\nrequests\n# no\n"), (2, "x/package.json", '{"dependencies": {"a": "^1.0"}, "devDependencies": {"b": "2.0"}}'), (3, "go.mod", "module m\nrequire github.com/x/y v1.2.3 // indirect\n"), (4, "package.json", "broken")], FILE)
    deps = D.parsed(df, ["id"])
    assert {(r.id, r.name, r.version) for r in deps.collect()} == {(1, "flask", "1.0"), (1, "Flask", "2"), (1, "requests", ""), (2, "a", "^1.0"), (2, "b", "2.0"), (3, "github.com/x/y", "v1.2.3")}
    assert {(r.id, r.name, r.category) for r in D.linted(deps, ["id"]).collect()} == {(1, "flask", "duplicate"), (1, "requests", "unpinned"), (2, "a", "loose_version")}
    adv = spark.createDataFrame([("flask", "1.0", "PyPI", "X-1", "CVSS:3.1/AV:N"), ("b", "2.0", "npm", "X-2", None)], "name string, version string, ecosystem string, advisory_id string, cvss_v3 string")
    assert {(r.advisory_id, r.severity) for r in D.vulnerable(deps, adv).collect()} == {("X-1", "high"), ("X-2", "medium")}
    body = '{"results": [{"check_id": "c", "path": "p", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR"}}]}'
    a = spark.createDataFrame([(1, 1, body), (2, 7, body), (3, 0, "broken")], "id int, exit_code int, body string")
    assert [(r.id, r.severity, r.line_start) for r in D.scanner_findings(a, ["id"]).collect()] == [(1, "high", 3)]
    g = spark.createDataFrame([(1, "go.mod", "x // indirect\n" * 21), (2, "go.mod", "x // indirect\n")], FILE)
    assert [r.id for r in D.too_indirect(g, ["id"]).collect()] == [1]


def test_boundary_chunks(spark):
    from auditlake.operators import context as O

    text = "import os\n\n\n" + "".join(f"@d\ndef f{i}(a):\n" + "    x = 'some text here'\n" * (5 + i) + "\n\n" for i in range(12))
    rows = O.cut_at_definitions(text, 100)
    lines = text.split("\n")
    assert rows[0][0] == 1 and rows[-1][1] == len(lines) and len(rows) > 3
    for (a, b, t), (c, _, _) in zip(rows, rows[1:]):
        assert c == b + 1 and lines[c - 1] == "@d"
    assert O.cut_at_definitions("def (", 5) == [(1, 1, 1)]
    df = spark.createDataFrame([(1, "a.py", text), (2, "b.go", "x\ny"), (3, "c.py", None)], FILE)
    assert {r.id for r in O.boundary_chunks(df, ["id"]).collect()} == {1, 2}


def test_repeated_and_broken_manifests(spark):
    df = spark.createDataFrame([(1, "requirements.txt", "a==1\nB\nA\nb>2\na"), (2, "x/package.json", "{oops"), (3, "package.json", '{"dependencies": {}}'), (4, "package.json", ""), (5, None, "{")], FILE)
    got = {(r.id, r.name, r.line_no, r.occurrence, r.first_line) for r in D.repeated(D.parsed(df, ["id"]), ["id"]).collect()}
    assert got == {(1, "a", 3, 2, 1), (1, "b", 4, 2, 2), (1, "a", 5, 3, 1)}
    assert {(r.id, r.category) for r in D.broken_manifests(df, ["id"]).collect()} == {(2, "invalid_json")}
