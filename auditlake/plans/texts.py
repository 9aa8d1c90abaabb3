"""Queries on files, their lines and their imports."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import dependencies as D
from auditlake.operators import findings as O
from auditlake.operators import graph as G
from auditlake.operators import text as X
from auditlake.plans.base import C_, F_, LANG, T_, files, findings, long, query, tasks
from auditlake.session import table

_END = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_LINES = f"v AS (SELECT review_id, file_seq, path, unnest(string_split_regex(content, {_END})) AS line, generate_subscripts(string_split_regex(content, {_END}), 1) AS line_no, len(string_split_regex(content, {_END})) AS n FROM c WHERE content <> ''), l AS (SELECT review_id, file_seq, path, CAST(line_no AS BIGINT) AS line_no, line FROM v WHERE NOT (line_no = n AND line = ''))"
_KEY = ["review_id", "file_seq"]
_SP = r"e' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f' || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def q_(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("SELECT review_id, file_seq, line_no, length(line) AS line_len FROM l", C_, _LINES)
def lines(spark, d):
    return X.exploded(files(spark, d, "content"), _KEY).select(*_KEY, F.col("line_no").cast("long"), F.length("line").cast("long").alias("line_len"))


@query(f"SELECT review_id, file_seq, {LANG} AS language FROM c", C_)
def detect_language(spark, d):
    return files(spark, d, "path").select(*_KEY, S.language_of(F.col("path")).alias("language"))


@query(f"SELECT c.review_id, c.file_seq, c.path FROM (SELECT *, {LANG} AS lang FROM c) c JOIN (SELECT review_id, CASE WHEN config IS NULL OR config = '' THEN 'auto' ELSE coalesce(json_extract_string(config, '$.target'), 'auto') END AS target FROM t) t ON c.review_id = t.review_id WHERE target = 'auto' OR target = lang", C_, T_)
def lang_filter(spark, d):
    t = tasks(spark, d, "config").select("review_id", F.coalesce(F.get_json_object(F.nullif("config", F.lit("")), "$.target"), F.lit("auto")).alias("target"))
    c = files(spark, d, "path").join(t, "review_id")
    return c.where((F.col("target") == "auto") | (F.col("target") == S.language_of(F.col("path")))).select(*_KEY, "path")


@query("SELECT review_id, count(*) AS n_files, count(*) FILTER (length(content) > 1048576) AS n_large, count(*) <= 50 AND count(*) FILTER (length(content) > 1048576) = 0 AS accepted FROM c GROUP BY 1", C_)
def ingest_limits(spark, d):
    large = F.count_if(F.length("content") > 1_048_576)
    return files(spark, d, "content").groupBy("review_id").agg(F.count("*").alias("n_files"), large.alias("n_large"), ((F.count("*") <= 50) & (large == 0)).alias("accepted"))


@query("SELECT DISTINCT t.review_id, p.path FROM (SELECT review_id, unnest(file_paths) AS path FROM t) p JOIN t ON t.review_id = p.review_id WHERE p.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code_files c WHERE c.review_id = p.review_id AND c.path = p.path)", T_)
def parse_failures(spark, d):
    asked = tasks(spark, d, "file_paths").select("review_id", F.explode("file_paths").alias("path")).where("path is not null").distinct()
    return asked.join(table(spark, d, "code_files").select("review_id", "path"), ["review_id", "path"], "left_anti")


@query("SELECT review_id, path, 'fetched' AS origin FROM (SELECT DISTINCT review_id, path FROM code_files WHERE path IS NOT NULL) UNION ALL SELECT review_id, path, 'requested' FROM (SELECT DISTINCT review_id, unnest(file_paths) AS path FROM t) p WHERE p.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code_files c WHERE c.review_id = p.review_id AND c.path = p.path)", T_)
def file_merge(spark, d):
    have = table(spark, d, "code_files").where("path is not null").select("review_id", "path").distinct()
    return have.withColumn("origin", F.lit("fetched")).unionByName(parse_failures(spark, d).withColumn("origin", F.lit("requested")))


def _in_sql(rx: str) -> tuple[str, str]:
    """An expression, and one that lines must not match, without the look-ahead that SQL lacks."""
    ahead = re.search(r"(\w+\\\.\w+\\s\*\\\()\(\?!(.*?Loader)\)", rx)
    return (rx.replace(f"(?!{ahead.group(2)})", ""), f"(?i){ahead.group(1)}{ahead.group(2)}") if ahead else (rx, "[^\\s\\S]")


_RULES = "r(rule_id, rule_order, lang, category, severity, rx, no) AS (VALUES " + ", ".join(f"({q_(rid)}, {order}, {q_(lang)}, {q_(cat)}, {q_(sev)}, {q_(_in_sql(rx)[0])}, {q_(_in_sql(rx)[1])})" for rid, order, langs, cat, sev, rx in X.RULES for lang in langs) + ")"
_NOTED = "CASE WHEN lang = 'python' THEN trim(line) LIKE '#%' ELSE trim(line) LIKE '//%' OR trim(line) LIKE '/*%' OR trim(line) LIKE '*%' END"
_CODE = f"m AS (SELECT *, {LANG} AS lang FROM l), w AS (SELECT * FROM m WHERE NOT ({_NOTED}) AND NOT regexp_matches(line, {q_(X.ENV)}) AND NOT regexp_matches(line, {q_(X.TYPED)})), h AS (SELECT w.review_id, w.file_seq, w.line_no, r.rule_id, r.rule_order, r.category, r.severity FROM w JOIN r ON w.lang = r.lang AND regexp_matches(w.line, r.rx) AND NOT regexp_matches(w.line, r.no))"
_SQL_RULES = "sr(lang, rule_order, rx, rule) AS (VALUES " + ", ".join(f"({q_(lang)}, {order}, {q_(rx)}, {q_(name)})" for lang, order, rx, name in X.SQL_RULES) + ")"


@query("SELECT review_id, file_seq, line_no, rule_id, category, severity FROM h", C_, _LINES, _RULES, _CODE)
def rule_scan(spark, d):
    return X.rule_hits(files(spark, d, "path", "content"), _KEY).drop("rule_order").transform(long("line_no"))


@query("SELECT review_id, file_seq, line_no, min_by(rule_id, rule_order) AS rule_id FROM h GROUP BY 1, 2, 3", C_, _LINES, _RULES, _CODE)
def first_rule_wins(spark, d):
    return X.first_hits(X.rule_hits(files(spark, d, "path", "content"), _KEY), _KEY).transform(long("line_no"))


@query(f"SELECT review_id, file_seq, line_no, min_by(rule, rule_order) AS rule FROM (SELECT *, {LANG} AS lang FROM l) m JOIN sr USING (lang) WHERE NOT ({_NOTED}) AND regexp_matches(line, rx) GROUP BY 1, 2, 3", C_, _LINES, _SQL_RULES)
def sql_skill(spark, d):
    return X.sql_hits(files(spark, d, "path", "content"), _KEY).transform(long("line_no"))


_STYLE = f"b AS (SELECT * FROM l WHERE trim(line, {_SP}) <> '')"


@query(f"SELECT review_id, file_seq, line_no, 'line_too_long' AS category FROM b WHERE length(line) > 120 UNION ALL SELECT review_id, file_seq, line_no, 'trailing_whitespace' FROM b WHERE rtrim(line, {_SP}) <> line UNION ALL SELECT review_id, file_seq, 0, 'mixed_indent' FROM b GROUP BY 1, 2 HAVING bool_or(contains(regexp_extract(line, '^[ \\t]*'), chr(9))) AND bool_or(contains(regexp_extract(line, '^[ \\t]*'), ' '))", C_, _LINES, _STYLE)
def style_lines(spark, d):
    return X.style_hits(files(spark, d, "content"), _KEY).transform(long("line_no"))


@query(f"SELECT review_id, file_seq, line_no FROM (SELECT review_id, file_seq, path, line_no, trim(line, {_SP}) AS b, lead(trim(line, {_SP})) OVER (PARTITION BY review_id, file_seq ORDER BY line_no) AS n FROM l WHERE path LIKE '%.py') WHERE (b LIKE 'def %' OR b LIKE 'class %') AND n <> '' AND n NOT LIKE '#%'", C_, _LINES)
def missing_blank_line(spark, d):
    return X.missing_blank_lines(files(spark, d, "path", "content"), _KEY).transform(long("line_no"))


@query("SELECT l.review_id, l.file_seq, l.line_no, count(f.arrival_seq) AS n_notes, string_agg(f.title, ' | ' ORDER BY f.arrival_seq) AS notes FROM l LEFT JOIN f ON f.review_id = l.review_id AND f.file_path = l.path AND greatest(coalesce(f.line_start, 1), 1) = l.line_no GROUP BY 1, 2, 3", C_, _LINES, F_)
def annotate_lines(spark, d):
    # Notes are gathered per place before the join, so that lines are joined once and never regrouped.
    f = findings(spark, d, "review_id", "file_path", "line_start", "title").where("file_path is not null")
    notes = f.groupBy("review_id", F.col("file_path").alias("path"), F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)).alias("line_no")).agg(F.count("*").alias("n_notes"), F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("arrival_seq", "title")))).alias("t"))
    notes = notes.select("review_id", "path", "line_no", "n_notes", F.nullif(F.array_join(F.transform("t", lambda x: x["title"]), " | "), F.lit("")).alias("notes"))
    lines_ = X.exploded(files(spark, d, "path", "content"), [*_KEY, "path"]).drop("line")
    return lines_.join(notes, ["review_id", "path", "line_no"], "left").select(*_KEY, F.col("line_no").cast("long"), F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), "notes")


_MODULE = f"CASE WHEN lang = 'python' AND suffix(bare, '__init__') THEN trim(translate(CASE WHEN contains(bare, '/') THEN regexp_replace(bare, '/[^/]*$', '') ELSE bare END, '/\\', '..'), '.') ELSE trim(translate(bare, '/\\', '..'), '.') END"
_MODULES = f"o AS (SELECT review_id, file_seq, path, content, {LANG} AS lang FROM c WHERE path IS NOT NULL), n AS (SELECT *, CASE WHEN suffix(path, sfx) THEN left(path, length(path) - length(sfx)) ELSE path END AS bare FROM (SELECT *, CASE lang WHEN 'go' THEN '.go' WHEN 'typescript' THEN '.ts' WHEN 'javascript' THEN '.js' WHEN 'java' THEN '.java' ELSE '.py' END AS sfx FROM o)), md AS (SELECT review_id, file_seq, lang, content, {_MODULE} AS module FROM n)"


def _modules(spark, d):
    c = files(spark, d, "path").where("path is not null")
    return c.select(*_KEY, S.module_of(F.col("path"), S.language_of(F.col("path"))).alias("module"))


@query("SELECT review_id, file_seq, module FROM md", C_, _MODULES)
def path_to_module(spark, d):
    return _modules(spark, d)


def _found(rx: str, text: str = "content") -> str:
    return f"regexp_extract_all({text}, {q_(rx)}, 1)"


_I = X.IMPORTS
_PY = f"im AS (SELECT review_id, file_seq, unnest(list_concat(flatten(list_transform({_found(_I['python'][0])}, lambda x: string_split_regex(x, '\\s*,\\s*'))), {_found(_I['python'][1])})) AS imported FROM md WHERE lang = 'python' AND content IS NOT NULL)"
_JS = f"ij AS (SELECT review_id, file_seq, lang, unnest(list_concat({_found(_I['script'][0])}, {_found(_I['script'][1])})) AS imported FROM md WHERE lang IN ('typescript', 'javascript') AND content IS NOT NULL)"
_GO_BLOCK = f"regexp_extract(content, {q_(_I['go'][1])}, 1)"
_GO = f"ig AS (SELECT review_id, file_seq, unnest(list_concat({_found(_I['go'][0])}, {_found(_I['go'][2], _GO_BLOCK)})) AS imported FROM md WHERE lang = 'go' AND content IS NOT NULL)"
_JAVA = f"iv AS (SELECT review_id, file_seq, unnest({_found(_I['java'][0])}) AS imported FROM md WHERE lang = 'java' AND content IS NOT NULL)"
_IMPORTS = f"{_JS}, {_GO}, {_JAVA}"


def _sources(spark, d):
    return files(spark, d, "path", "content").where("path is not null")


@query("SELECT * FROM im", C_, _MODULES, _PY)
def imports_extract(spark, d):
    return X.python_imports(_sources(spark, d), _KEY)


@query("SELECT review_id, file_seq, imported FROM ij", C_, _MODULES, _JS)
def script_imports_extract(spark, d):
    return X.script_imports(_sources(spark, d), _KEY)


@query("SELECT * FROM ig", C_, _MODULES, _GO)
def go_imports_extract(spark, d):
    return X.go_imports(_sources(spark, d), _KEY)


@query("SELECT * FROM iv", C_, _MODULES, _JAVA)
def java_imports_extract(spark, d):
    return X.java_imports(_sources(spark, d), _KEY)


#: Manifests beside those of the tables, which hold none.
_MANIFESTS = [("fixture", 1, "requirements.txt", "requests==2.31.0\nflask>=2.0\n# requests\nRequests\nflask~=3.0  # again\nrequests\n"), ("fixture", 2, "svc/requirements-dev.txt", "pytest==8.0\nblack\n"), ("fixture", 3, "requirements.txt", "numpy\nNumPy==2.0\n")]
_DEPS = "mf AS (SELECT review_id, file_seq, path, content FROM c UNION ALL VALUES " + ", ".join(f"({q_(r)}, {n}, {q_(p)}, {q_(t)})" for r, n, p, t in _MANIFESTS) + "), ml AS (SELECT review_id, file_seq, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM mf WHERE regexp_matches(path, '(^|[/\\\\])requirements[^/\\\\]*\\.txt$')), dp AS (SELECT review_id, file_seq, CAST(line_no AS BIGINT) AS line_no, lower(regexp_extract(trim(regexp_replace(line, '\\s*(#|//).*$', '')), '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) AS name FROM ml)"


@query("SELECT * FROM (SELECT review_id, file_seq, name, line_no, row_number() OVER w AS occurrence, min(line_no) OVER w AS first_line FROM dp WHERE name <> '' WINDOW w AS (PARTITION BY review_id, file_seq, name ORDER BY line_no)) WHERE occurrence > 1", C_, _DEPS)
def dup_dependency(spark, d):
    """The second and later entries of a name in a manifest, with the line of the first."""
    known = files(spark, d, "path", "content").select(*_KEY, "path", "content")
    fixed = spark.createDataFrame(_MANIFESTS, "review_id string, file_seq int, path string, content string")
    return D.repeated(D.parsed(known.unionByName(fixed), _KEY).where("ecosystem = 'PyPI'"), _KEY).transform(long("line_no", "occurrence", "first_line"))


_EXTERNAL = "ex(lang, top) AS (VALUES " + ", ".join(f"({q_(lang)}, {q_(x)})" for lang, names in G.EXTERNAL.items() for x in names) + ")"
_RESOLVED = f"ia AS (SELECT *, 'python' AS lang FROM im UNION ALL SELECT review_id, file_seq, imported, lang FROM ij UNION ALL SELECT *, 'go' FROM ig UNION ALL SELECT *, 'java' FROM iv), ir AS (SELECT review_id, file_seq, CASE WHEN rel THEN trim(translate(imported, '/', '.'), '.') WHEN lang = 'go' THEN translate(imported, '/', '.') ELSE imported END AS imported FROM (SELECT *, lang IN ('typescript', 'javascript') AND imported LIKE '.%' AS rel, CASE WHEN lang IN ('go', 'typescript', 'javascript') THEN string_split(imported, '/')[1] ELSE string_split(imported, '.')[1] END AS top FROM ia) a WHERE rel OR lang = 'java' AND NOT contains(imported, '.') OR NOT EXISTS (SELECT 1 FROM ex WHERE ex.lang = a.lang AND ex.top = a.top))"
_EDGES = f"{_IMPORTS}, {_EXTERNAL}, {_RESOLVED}, ed AS (SELECT DISTINCT i.review_id, s.module AS src, coalesce(x.module, y.module, i.imported) AS dst, CASE WHEN x.module IS NOT NULL THEN 'exact' WHEN y.module IS NOT NULL THEN 'simple' ELSE 'external' END AS kind FROM ir i JOIN md s ON s.review_id = i.review_id AND s.file_seq = i.file_seq LEFT JOIN (SELECT DISTINCT review_id, module FROM md) x ON x.review_id = i.review_id AND x.module = i.imported LEFT JOIN (SELECT review_id, string_split(module, '.')[-1] AS simple, min_by(module, file_seq) AS module FROM md GROUP BY 1, 2) y ON y.review_id = i.review_id AND y.simple = string_split(i.imported, '.')[-1] WHERE i.imported <> s.module)"


def _edges(spark, d):
    c = _sources(spark, d).withColumn("language", S.language_of(F.col("path")))
    keep = [*_KEY, "language"]
    found = X.python_imports(c, keep)
    for f in (X.script_imports, X.go_imports, X.java_imports):
        found = found.unionByName(f(c, keep))
    return G.import_edges(_modules(spark, d), found)


@query("SELECT * FROM ed", C_, _MODULES, _PY, _EDGES)
def import_edges(spark, d):
    return _edges(spark, d)


@query("SELECT review_id, module, in_degree, CASE WHEN in_degree > 10 THEN 'critical' WHEN in_degree > 8 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT review_id, dst AS module, count(DISTINCT src) AS in_degree FROM ed GROUP BY 1, 2) WHERE in_degree > 5", C_, _MODULES, _PY, _EDGES)
def coupling_degree(spark, d):
    return G.coupled(_edges(spark, d))


@query("SELECT a.review_id, a.module FROM (SELECT DISTINCT review_id, module FROM md WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.review_id = md.review_id AND (ed.src = md.module OR ed.dst = md.module))) a JOIN (SELECT review_id FROM md GROUP BY 1 HAVING count(*) >= 2) s ON s.review_id = a.review_id QUALIFY count(*) OVER (PARTITION BY a.review_id) <= 10", C_, _MODULES, _PY, _EDGES)
def isolated_nodes(spark, d):
    return G.isolated(_modules(spark, d), _edges(spark, d))


_CYCLE = "x AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey * 5 FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey + 1) % 25 FROM nation), y AS (SELECT DISTINCT src, dst FROM x WHERE src <> dst)"


@query("SELECT array_to_string(path, '>') AS cycle FROM p JOIN y ON y.src = p.path[-1] AND y.dst = p.path[1]", _CYCLE, "p0 AS (SELECT [src, dst] AS path FROM y WHERE dst > src), p1 AS (SELECT list_append(path, dst) AS path FROM p0 JOIN y ON y.src = path[-1] WHERE dst > path[1] AND NOT list_contains(path, dst)), p2 AS (SELECT list_append(path, dst) AS path FROM p1 JOIN y ON y.src = path[-1] WHERE dst > path[1] AND NOT list_contains(path, dst)), p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)")
def graph_cycles(spark, d):
    n = table(spark, d, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    e = n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst")).union(n.select(k, r * 5)).union(n.select(k, (k + r + 1) % 25))
    return G.cycles(e, longest=4).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"))


_LOOPS = "g AS (SELECT DISTINCT review_id, src, dst FROM ed WHERE src <> dst), lp AS (SELECT review_id, [src, dst] AS path FROM g WHERE dst > src UNION ALL SELECT lp.review_id, list_append(path, dst) FROM lp JOIN g ON g.review_id = lp.review_id AND g.src = path[-1] WHERE len(path) < 6 AND dst > path[1] AND NOT list_contains(path, dst)), re AS (SELECT review_id, src, dst FROM g UNION SELECT re.review_id, re.src, g.dst FROM re JOIN g ON g.review_id = re.review_id AND g.src = re.dst), sc AS (SELECT DISTINCT review_id, members FROM (SELECT a.review_id, a.src, list_sort(list(a.dst)) AS members FROM re a JOIN re b ON b.review_id = a.review_id AND b.src = a.dst AND b.dst = a.src GROUP BY 1, 2))"


@query("SELECT lp.review_id, 'cycle' AS kind, array_to_string(path, '>') AS modules FROM lp JOIN g ON g.review_id = lp.review_id AND g.src = path[-1] AND g.dst = path[1] UNION ALL SELECT review_id, 'component', array_to_string(members, '>') FROM sc WHERE len(members) > 6", "RECURSIVE " + C_, _MODULES, _PY, _EDGES, _LOOPS)
def import_cycles(spark, d):
    return G.cycle_report(_edges(spark, d), longest=6).withColumn("modules", F.array_join("modules", ">"))


@query(r"SELECT review_id, file_seq, unnest(list_concat(list_transform(regexp_extract_all(content, '(?m)^[ \t]*class[ \t]+(\w+)', 1), lambda x: 'class ' || x), list_transform(regexp_extract_all(content, '(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)', 1), lambda x: 'def ' || x))) AS symbol FROM md WHERE lang = 'python' AND content IS NOT NULL", C_, _MODULES)
def symbols(spark, d):
    found = lambda rx, word: F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), lambda x: F.concat(F.lit(word), x))
    both = F.concat(found(r"(?m)^[ \t]*class[ \t]+(\w+)", "class "), found(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", "def "))
    return files(spark, d, "path", "content").where(S.language_of(F.col("path")) == "python").select(*_KEY, F.explode(both).alias("symbol"))


@query(r"SELECT review_id, file_seq, line_no, line FROM (SELECT review_id, file_seq, line_no, line, row_number() OVER (PARTITION BY review_id, file_seq ORDER BY line_no) AS pos FROM l WHERE regexp_matches(line, '^[ \t]*(def|class|async def|func|function|export|public|interface|type)[ \t]')) WHERE pos <= 30", C_, _LINES)
def signature_lines(spark, d):
    x = X.exploded(files(spark, d, "content"), _KEY).where(F.col("line").rlike(r"^[ \t]*(def|class|async def|func|function|export|public|interface|type)[ \t]"))
    return O.top_per(x, _KEY, [F.col("line_no")], 30).select(*_KEY, "line_no", "line").transform(long("line_no"))


@query()
def chunk_fixed(spark, d):
    return X.fixed_chunks(files(spark, d, "content"), _KEY)


_TOKENS = "CAST(CASE WHEN content IS NULL OR content = '' THEN 0 ELSE greatest(1, length(content) // 4) END AS BIGINT)"


@query(f"SELECT review_id, file_seq, tokens, CASE WHEN tokens <= 500 THEN 'whole' ELSE 'chunks' END AS way FROM (SELECT review_id, file_seq, {_TOKENS} AS tokens FROM c)", C_)
def chunk_switch(spark, d):
    t = files(spark, d, "content").select(*_KEY, S.token_estimate(F.col("content")).cast("long").alias("tokens"))
    return t.withColumn("way", F.when(F.col("tokens") <= 500, "whole").otherwise("chunks"))


@query("SELECT review_id, file_seq, md5(left(content, 2000)) AS cut, length(left(content, 2000)) AS n FROM c WHERE content IS NOT NULL", C_)
def hard_cut(spark, d):
    cut = F.left("content", F.lit(2000))
    return files(spark, d, "content").where("content is not null").select(*_KEY, F.md5(cut).alias("cut"), F.length(cut).cast("long").alias("n"))


@query(f"SELECT review_id, file_seq, CASE WHEN length(s) > 80 THEN left(s, 80) || '...' ELSE s END AS summary FROM (SELECT review_id, file_seq, min_by(trim(line, {_SP}), line_no) AS s FROM l WHERE trim(line, {_SP}) <> '' GROUP BY 1, 2)", C_, _LINES)
def first_line_summary(spark, d):
    bare = F.filter(F.transform(S.lines_of(F.col("content")), lambda x: F.btrim(x, F.lit(X.SPACE))), lambda x: x != "")
    c = files(spark, d, "content").select(*_KEY, F.get(bare, F.lit(0)).alias("s")).where("s is not null")
    return c.select(*_KEY, S.truncated(F.col("s"), 80).alias("summary"))


@query("SELECT review_id, file_seq, CAST(sum(tokens) OVER (PARTITION BY review_id ORDER BY file_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, CAST(greatest(0, 16000 - 2000 - sum(tokens) OVER (PARTITION BY review_id ORDER BY file_seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS available FROM (SELECT review_id, file_seq, " + _TOKENS + " AS tokens FROM c)", C_)
def budget_usage(spark, d):
    t = files(spark, d, "content").select(*_KEY, S.token_estimate(F.col("content")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("review_id").orderBy("file_seq").rowsBetween(Window.unboundedPreceding, 0))
    return t.select(*_KEY, used.alias("used"), F.greatest(F.lit(0), F.lit(14000) - used).alias("available"))


_DIFF = r"df AS (SELECT review_id, file_seq, line_no, line, CASE WHEN regexp_matches(line, '^@@ -\d+(,\d+)? \+\d+(,\d+)? @@') THEN 'hunk' WHEN line LIKE '+%' AND line NOT LIKE '+++%' THEN 'added' WHEN line LIKE '-%' AND line NOT LIKE '---%' THEN 'removed' WHEN line LIKE ' %' THEN 'context' ELSE 'other' END AS kind FROM l WHERE (review_id, file_seq) IN (SELECT (review_id, file_seq) FROM c WHERE content LIKE '@@ -%')), dg AS (SELECT *, sum(CASE WHEN kind = 'hunk' THEN 1 ELSE 0 END) OVER (PARTITION BY review_id, file_seq ORDER BY line_no) AS seg FROM df), dn AS (SELECT review_id, file_seq, line_no, kind, first_value(CASE WHEN kind = 'hunk' THEN regexp_extract(line, '^@@ -(\d+)', 1)::BIGINT END) OVER w + count(*) FILTER (kind IN ('removed', 'context')) OVER w AS ol, first_value(CASE WHEN kind = 'hunk' THEN regexp_extract(line, '\+(\d+)', 1)::BIGINT END) OVER w + count(*) FILTER (kind IN ('added', 'context')) OVER w AS nl FROM dg WINDOW w AS (PARTITION BY review_id, file_seq, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("SELECT review_id, file_seq, line_no, kind, CASE WHEN kind = 'removed' THEN ol ELSE 0 END AS old_line, CASE WHEN kind = 'added' THEN nl ELSE 0 END AS new_line FROM dn WHERE kind IN ('added', 'removed')", C_, _LINES, _DIFF)
def diff_line_numbers(spark, d):
    return X.diff_lines(files(spark, d, "content").where("content like '@@ -%'"), _KEY).transform(long("line_no", "old_line", "new_line"))


@query("SELECT review_id, file_seq, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed FROM df GROUP BY 1, 2", C_, _LINES, _DIFF)
def diff_totals(spark, d):
    x = files(spark, d, "content").where("content like '@@ -%'")
    lines_ = S.lines_of(F.col("content"))
    n = lambda a, b: F.size(F.filter(lines_, lambda x: x.startswith(a) & ~x.startswith(b))).cast("long")
    return x.select(*_KEY, n("+", "+++").alias("added"), n("-", "---").alias("removed"))


@query("SELECT review_id, file_seq, coalesce(string_agg(substring(line, 2), chr(10) ORDER BY line_no) FILTER (line NOT LIKE '@@%' AND (line LIKE '+%' OR line LIKE ' %')), '') AS content FROM df GROUP BY 1, 2", C_, _LINES, _DIFF)
def patch_rebuild(spark, d):
    return files(spark, d, "content").where("content like '@@ -%'").select(*_KEY, X.rebuilt_from_patch(F.col("content")).alias("content"))


@query(f"SELECT arrival_seq, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM f WHERE title IS NOT NULL", F_)
def html_escape(spark, d):
    return findings(spark, d, "title").where("title is not null").select("arrival_seq", S.html_escape(F.col("title")).alias("html"))


@query("SELECT arrival_seq, CASE WHEN length(title) > 60 THEN left(title, 60) || '...' ELSE title END AS title, left(code_snippet, 200) AS snippet FROM f", F_)
def truncate(spark, d):
    return findings(spark, d, "title", "code_snippet").select("arrival_seq", S.truncated(F.col("title"), 60).alias("title"), F.left("code_snippet", F.lit(200)).alias("snippet"))


@query("SELECT review_id, CASE WHEN commit_sha IS NULL OR commit_sha = '' OR commit_sha LIKE 'your-%' THEN '(unset)' WHEN length(commit_sha) <= 8 THEN '........' ELSE left(commit_sha, 4) || '...' || right(commit_sha, 2) END AS masked FROM t", T_)
def mask_key(spark, d):
    return tasks(spark, d, "commit_sha").select("review_id", S.masked_key(F.col("commit_sha")).alias("masked"))


_URL = r"'^https?://([^/]+)/([^/]+)/([^/]+)(?:/(blob|tree)/([^/]+))?(?:/.*)?$'"
_U = r"regexp_replace(regexp_replace(trim(repo_url), '\.git$', ''), '/+$', '')"


@query(f"SELECT repo_url, lower(nullif(regexp_extract(u, {_URL}, 1), '')) AS host, nullif(regexp_extract(u, {_URL}, 2), '') AS owner, regexp_replace(nullif(regexp_extract(u, {_URL}, 3), ''), '\\.git$', '') AS repo, nullif(regexp_extract(u, {_URL}, 5), '') AS branch, CASE regexp_extract(u, {_URL}, 4) WHEN 'blob' THEN 'file' WHEN 'tree' THEN 'dir' ELSE CASE WHEN regexp_extract(u, {_URL}, 3) <> '' THEN 'repo' END END AS kind FROM (SELECT DISTINCT repo_url, {_U} AS u FROM review_tasks WHERE repo_url IS NOT NULL)")
def url_parse(spark, d):
    return table(spark, d, "review_tasks").where("repo_url is not null").select("repo_url").distinct().select("repo_url", *S.repo_parts(F.col("repo_url")))


@query(r"""SELECT arrival_seq, CASE WHEN a = '' THEN NULL ELSE CAST(json_array_length(regexp_replace(a, ',\s*\]', ']')) AS BIGINT) END AS n FROM (SELECT arrival_seq, regexp_extract('Result: [{"n": ' || arrival_seq || '}, {"n": ' || coalesce(line_start, 0) || '},] end' || CASE WHEN arrival_seq % 7 = 0 THEN '' ELSE '' END, '(?s)\[.*\]') AS a FROM f)""", F_)
def json_salvage(spark, d):
    # The widest bracketed part of a model's answer, with a trailing comma repaired.
    said = F.concat(F.lit('Result: [{"n": '), "arrival_seq", F.lit('}, {"n": '), F.coalesce("line_start", F.lit(0)), F.lit("},] end"))
    body = F.regexp_replace(F.regexp_extract(said, r"(?s)\[.*\]", 0), r",\s*\]", "]")
    return findings(spark, d, "line_start").select("arrival_seq", F.size(F.from_json(body, "array<struct<n: bigint>>")).cast("long").alias("n"))


@query(f"SELECT h.review_id, count(*) AS n_hits, count(DISTINCT h.file_seq) AS n_files, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, CAST(floor((least(200, greatest(0, 200 - 20 * count(*) FILTER (severity = 'critical') - 10 * count(*) FILTER (severity = 'high'))) + 1) / 2) AS BIGINT) AS score_tenths FROM (SELECT DISTINCT review_id, file_seq, line_no, category, severity FROM h) h GROUP BY 1", C_, _LINES, _RULES, _CODE)
def pipeline_e2e(spark, d):
    hits = X.rule_hits(files(spark, d, "path", "content"), _KEY).select(*_KEY, "line_no", "category", "severity").distinct()
    g = hits.groupBy("review_id").agg(F.count("*").alias("n_hits"), F.count_distinct("file_seq").alias("n_files"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    zero = F.lit(0)
    return g.withColumn("score_tenths", S.score_tenths(F.col("critical"), F.col("high"), zero, zero))
