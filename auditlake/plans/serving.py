"""Queries on reviews, histories, knowledge and message windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import findings as O
from auditlake.operators import memory as M
from auditlake.plans.base import E_, F_, K_, T_, WEIGHT, episodes, findings, knowledge, long, query, tasks
from auditlake.session import table

_LIST = "ls AS (SELECT t.review_id, t.repo_url, t.branch, t.status, t.created_at, coalesce(e.score, 0) AS score, coalesce(n.n, 0) AS issues_count FROM t LEFT JOIN e ON e.task_id = t.review_id LEFT JOIN (SELECT review_id, count(arrival_seq) AS n FROM f GROUP BY 1) n ON n.review_id = t.review_id)"


def _list(spark, d):
    # Findings are counted per review before the join: the report is one to one, so nothing is multiplied.
    t = tasks(spark, d, "repo_url", "branch", "status", "created_at")
    e = episodes(spark, d, "score").withColumnRenamed("task_id", "review_id")
    n = findings(spark, d, "review_id").groupBy("review_id").agg(F.count("arrival_seq").alias("n"))
    x = t.join(e, "review_id", "left").join(n, "review_id", "left")
    return x.select("review_id", "repo_url", "branch", "status", "created_at", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("issues_count"))


@query("SELECT * FROM ls WHERE score BETWEEN 0 AND 10 AND (repo_url ILIKE '%app%' OR branch ILIKE '%main%')", F_, T_, E_, _LIST)
def review_list(spark, d):
    return _list(spark, d).where(F.col("score").between(0, 10) & (F.col("repo_url").ilike("%app%") | F.col("branch").ilike("%main%")))


@query("SELECT * FROM ls WHERE status = 'completed' ORDER BY created_at DESC, review_id LIMIT 20 OFFSET 20", F_, T_, E_, _LIST)
def review_page(spark, d):
    return _list(spark, d).where("status = 'completed'").orderBy(F.desc("created_at"), "review_id").offset(20).limit(20)


@query("SELECT count(*) AS total FROM ls WHERE score BETWEEN 5 AND 10", F_, T_, E_, _LIST)
def review_list_total(spark, d):
    return _list(spark, d).where(F.col("score").between(5, 10)).agg(F.count("*").alias("total"))


@query("SELECT count(*) AS total, coalesce(round(avg(CAST(score AS DECIMAL(10, 2))), 1), 0) AS avg_score FROM t LEFT JOIN e ON e.task_id = t.review_id", T_, E_)
def review_stats(spark, d):
    x = tasks(spark, d, "status").join(episodes(spark, d, "score").withColumnRenamed("task_id", "review_id"), "review_id", "left")
    return x.agg(F.count("*").alias("total"), F.coalesce(F.round(F.avg(F.col("score").cast("decimal(10,2)")).cast("double"), 1), F.lit(0.0)).alias("avg_score"))


@query("SELECT review_id, '# Review ' || review_id || chr(10) || chr(10) || string_agg(CAST(arrival_seq AS VARCHAR) || '. [' || coalesce(lower(severity), 'info') || '] ' || coalesce(title, '') || ' (' || coalesce(file_path, '-') || ':' || coalesce(line_start, 0) || ')', chr(10) ORDER BY arrival_seq) AS markdown FROM f GROUP BY 1", F_)
def report_markdown(spark, d):
    f = findings(spark, d, "review_id", "severity", "title", "file_path", "line_start")
    line = F.concat(F.col("arrival_seq").cast("string"), F.lit(". ["), F.coalesce(F.lower("severity"), F.lit("info")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("file_path", F.lit("-")), F.lit(":"), F.coalesce("line_start", F.lit(0)).cast("string"), F.lit(")"))
    g = f.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("arrival_seq", line.alias("x")))).alias("r"))  # a review's findings: one report
    return g.select("review_id", F.concat(F.lit("# Review "), "review_id", F.lit("\n\n"), F.array_join(F.transform("r", lambda r: r["x"]), "\n")).alias("markdown"))


_LE = [1, 5, 10, 30, 60, 120, 300]


@query("SELECT b.le, count(*) FILTER (e.value <= b.le) AS n FROM events e CROSS JOIN (VALUES " + ", ".join(f"({x}::BIGINT)" for x in _LE) + ") b(le) GROUP BY 1")
def latency_histogram(spark, d):
    one = table(spark, d, "events").agg(*[F.count_if(F.col("value") <= x).alias(str(x)) for x in _LE])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("le"), F.col(str(x)).alias("n")) for x in _LE])).alias("b")).select("b.*")


@query("SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE ((ms + 50) // 100) // 10 || '.' || ((ms + 50) // 100) % 10 || 's' END AS duration FROM (SELECT event_id, CAST(round(value * 37) AS BIGINT) AS ms FROM events)")
def duration_format(spark, d):
    e = table(spark, d, "events").select("event_id", F.round(F.col("value") * 37).cast("long").alias("ms"))
    return e.select("event_id", S.duration_text(F.col("ms")).alias("duration"))


@query("SELECT event_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE event_type IN ('signup', 'purchase') AND CAST(props->>'k' AS BIGINT) >= 50")
def event_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase") & (k >= 50)).select("event_id", "event_type", k.alias("k"))


@query("SELECT review_id, status, CASE WHEN status = 'running' AND epoch(now_ - created_at) > 300 THEN 'failed' ELSE status END AS shown FROM t, (SELECT max(updated_at) AS now_ FROM review_tasks)", T_)
def elapsed_timeout(spark, d):
    # The table's own clock, one row, in place of the wall clock.
    now = table(spark, d, "review_tasks").agg(F.max("updated_at").alias("now"))
    late = F.timestamp_diff("SECOND", F.col("created_at"), F.col("now")) > 300
    return tasks(spark, d, "status", "created_at").join(F.broadcast(now), F.lit(True)).select("review_id", "status", F.when((F.col("status") == "running") & late, "failed").otherwise(F.col("status")).alias("shown"))


@query("SELECT task_id, ts FROM (SELECT *, rank() OVER (ORDER BY ts DESC) AS r FROM e WHERE ts IS NOT NULL) WHERE r <= 100", E_)
def retention_100(spark, d):
    return M.retained(episodes(spark, d, "ts"), "ts", 100).select("task_id", "ts")


@query("SELECT task_id, ts FROM e ORDER BY ts DESC NULLS LAST, task_id LIMIT 5", E_)
def recent_k(spark, d):
    return episodes(spark, d, "ts").orderBy(F.desc_nulls_last("ts"), "task_id").limit(5)


@query("SELECT task_id, ts FROM e WHERE summary ILIKE '%fabric%' OR summary ILIKE '%drawer%' OR summary ILIKE '%mostly%' ORDER BY ts DESC NULLS LAST, task_id LIMIT 10", E_)
def history_search(spark, d):
    s = F.col("summary")
    return episodes(spark, d, "ts", "summary").where(s.ilike("%fabric%") | s.ilike("%drawer%") | s.ilike("%mostly%")).orderBy(F.desc_nulls_last("ts"), "task_id").limit(10).select("task_id", "ts")


_KW = ["review", "cache", "findings"]
_KWSQL = " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS BIGINT)" for w in _KW)


@query(f"SELECT doc_id, hits FROM (SELECT doc_id, {_KWSQL} AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20")
def keyword_topk(spark, d):
    return M.keyword_hits(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), _KW, 20, "doc_id").select("doc_id", "hits")


_QUERY = [(-1.0) ** i * (1 + i % 5) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 5")
def vector_topk(spark, d):
    return M.most_similar(table(spark, d, "embeddings"), "vec_id", "embedding", _QUERY, 5)


@query(f"SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS similarity FROM k WHERE len(embedding) = 64 AND language = 'python' AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true) ORDER BY similarity DESC, id LIMIT 5", K_)
def semantic_topk(spark, d):
    return M.most_similar(knowledge(spark, d, "embedding", "language").where("language = 'python'"), "id", "embedding", _QUERY, 5)


@query("SELECT id, category, language FROM k WHERE knowledge_type = 'rule' AND category = 'sql_injection' AND language = 'python'", K_)
def rules_filter(spark, d):
    return knowledge(spark, d, "knowledge_type", "category", "language").where("knowledge_type = 'rule' and category = 'sql_injection' and language = 'python'").select("id", "category", "language")


@query("SELECT id, category, language FROM k WHERE knowledge_type = 'pattern' AND category = 'sql_injection' AND language = 'python'", K_)
def patterns_filter(spark, d):
    return knowledge(spark, d, "knowledge_type", "category", "language").where("knowledge_type = 'pattern' and category = 'sql_injection' and language = 'python'").select("id", "category", "language")


@query("SELECT id, 'rules' AS part FROM k WHERE knowledge_type = 'rule' UNION ALL SELECT id, 'patterns' FROM k WHERE knowledge_type = 'pattern' UNION ALL SELECT id, 'practices' FROM k WHERE knowledge_type = 'best_practice'", K_)
def knowledge_union(spark, d):
    k = knowledge(spark, d, "knowledge_type")
    part = lambda t, name: k.where(F.col("knowledge_type") == t).select("id", F.lit(name).alias("part"))
    return part("rule", "rules").unionByName(part("pattern", "patterns")).unionByName(part("best_practice", "practices"))


@query("SELECT category, id, pos FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY ts DESC NULLS LAST, id) AS pos FROM k WHERE knowledge_type = 'best_practice' AND category IS NOT NULL) WHERE pos <= 3", K_)
def practices_top3(spark, d):
    k = knowledge(spark, d, "knowledge_type", "category", "ts").where("knowledge_type = 'best_practice' and category is not null")
    return O.top_per(k, ["category"], [F.desc_nulls_last("ts"), F.col("id")], 3).select("category", "id", "pos").transform(long("pos"))


@query("SELECT (SELECT count(DISTINCT category) FROM f) AS n_types, (SELECT count(*) FROM f WHERE category IS NOT NULL) AS n_findings, (SELECT count(*) FROM k) AS n_knowledge, (SELECT count(*) FROM e) AS n_episodes", F_, K_, E_)
def memory_totals(spark, d):
    parts = [
        findings(spark, d, "category").groupBy("category").agg(F.count("*").alias("n")).where("category is not null").agg(F.count("*").alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings")),
        knowledge(spark, d, "ts").agg(F.count("*").alias("n_knowledge")),
        episodes(spark, d, "ts").agg(F.count("*").alias("n_episodes")),
    ]
    return parts[0].join(parts[1], F.lit(True)).join(parts[2], F.lit(True))  # one row each


@query("(SELECT 1::BIGINT AS section, 'rule' AS part, id AS item, row_number() OVER (ORDER BY ts DESC NULLS LAST, id) AS pos FROM k WHERE knowledge_type = 'rule' AND language = 'python' ORDER BY ts DESC NULLS LAST, id LIMIT 5) UNION ALL (SELECT 2, 'practice', id, row_number() OVER (ORDER BY ts DESC NULLS LAST, id) FROM k WHERE knowledge_type = 'best_practice' ORDER BY ts DESC NULLS LAST, id LIMIT 5) UNION ALL (SELECT 3, 'episode', task_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, task_id) FROM e ORDER BY ts DESC NULLS LAST, task_id LIMIT 5) UNION ALL (SELECT 4, 'frequent', category, row_number() OVER (ORDER BY n DESC, seen) FROM (SELECT category, count(*) AS n, min(arrival_seq) AS seen FROM f WHERE category IS NOT NULL GROUP BY 1) ORDER BY n DESC, seen LIMIT 5)", K_, E_, F_)
def review_context(spark, d):
    from pyspark.sql import Window

    def part(no, name, df, item, order):
        top = df.orderBy(*order).limit(5)
        return top.select(F.lit(no).cast("long").alias("section"), F.lit(name).alias("part"), F.col(item).alias("item"), F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long").alias("pos"))  # five rows

    newest = lambda key: [F.desc_nulls_last("ts"), F.col(key)]
    k = knowledge(spark, d, "knowledge_type", "language", "ts")
    freq = findings(spark, d, "category").where("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("seen"))
    parts = [
        part(1, "rule", k.where("knowledge_type = 'rule' and language = 'python'"), "id", newest("id")),
        part(2, "practice", k.where("knowledge_type = 'best_practice'"), "id", newest("id")),
        part(3, "episode", episodes(spark, d, "ts"), "task_id", newest("task_id")),
        part(4, "frequent", freq, "category", [F.desc("n"), F.col("seen")]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# The shipped skills.
_SKILLS = [("ast_scan", "analysis", "python,go,java", "ast,stats", "Counts functions and classes"), ("complexity_check", "analysis", "python,go", "complexity", "Cyclomatic complexity of functions"), ("cve_check", "dependency", "python,javascript,go", "security,dependency", "Known vulnerabilities of dependencies"), ("dep_analyze", "dependency", "python,javascript,go", "dependency", "Lint of dependency manifests"), ("diff_context", "context", "any", "diff", "Context of a diff"), ("refactor_suggest", "refactor", "python", "smell", "Smells of long functions"), ("semgrep_scan", "security", "python,go,java,javascript", "security,scanner", "External scanner results"), ("sql_injection_detect", "security", "python,go,java,javascript,typescript", "security,sql", "SQL built from strings"), ("style_check", "style", "any", "style", "Line style")]


@query("SELECT name FROM (VALUES " + ", ".join(str(x) for x in _SKILLS) + ") s(name, category, languages, tags, description) WHERE category = 'security' AND list_contains(string_split(languages, ','), 'python') AND list_contains(string_split(tags, ','), 'security') AND (contains(lower(name), 'sql') OR contains(lower(description), 'scanner'))")
def skill_search(spark, d):
    s = spark.createDataFrame(_SKILLS, "name string, category string, languages string, tags string, description string")
    hit = (F.col("category") == "security") & F.array_contains(F.split("languages", ","), "python") & F.array_contains(F.split("tags", ","), "security")
    return s.where(hit & (F.lower("name").contains("sql") | F.lower("description").contains("scanner"))).select("name")


# Message windows: a user's events are a conversation, an event its turn, errors are system messages.
_MSG = "m AS (SELECT user_id, event_id, event_type = 'error' AS sys, CAST(props->>'k' AS BIGINT) + 4 AS tokens FROM events)"


def _messages(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("sys"), (F.get_json_object("props", "$.k").cast("long") + 4).alias("tokens"))


@query("SELECT user_id, event_id, tokens FROM (SELECT *, sum(tokens) FILTER (sys) OVER (PARTITION BY user_id) AS total, sum(tokens) OVER (PARTITION BY user_id, sys ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id, sys ORDER BY event_id DESC) AS rn FROM m) WHERE sys OR rn <= 3 OR run + coalesce(total, 0) <= 1500", _MSG)
def context_window(spark, d):
    return M.tail_within(_messages(spark, d), "user_id", "event_id", "tokens", F.col("sys"), 1500, 3).select("user_id", "event_id", "tokens")


@query("SELECT user_id, event_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5", _MSG)
def last_n_turns(spark, d):
    return O.top_per(_messages(spark, d), ["user_id"], [F.desc("event_id")], 5).select("user_id", "event_id")


_CMP = "x AS (SELECT user_id, event_id, CASE WHEN sys THEN 'system' WHEN count(*) OVER (PARTITION BY user_id, sys) <= 8 OR row_number() OVER (PARTITION BY user_id, sys ORDER BY event_id DESC) <= 6 THEN 'kept' ELSE 'omitted' END AS kind FROM m)"


@query("SELECT user_id, event_id, kind, 1::BIGINT AS n FROM x WHERE kind <> 'omitted' UNION ALL SELECT user_id, max(event_id), 'summary', count(*) FROM x WHERE kind = 'omitted' GROUP BY 1", _MSG, _CMP)
def compress_messages(spark, d):
    return M.compressed(_messages(spark, d), "user_id", "event_id", F.col("sys"))


@query("SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT user_id, last_ts FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1) WHERE last_ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY ORDER BY last_ts DESC, user_id LIMIT 200")
def ttl_lru(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("now"))
    return last.join(F.broadcast(now), F.col("last_ts") >= F.col("now") - F.expr("interval 3 days")).orderBy(F.desc("last_ts"), "user_id").limit(200).select("user_id", "last_ts")


@query(f"SELECT t.review_id, t.status, e.score, coalesce(g.n, 0) AS n_findings, coalesce(g.w, 0) AS worst FROM t LEFT JOIN e ON e.task_id = t.review_id LEFT JOIN (SELECT review_id, count(*) AS n, CAST(max({WEIGHT}) AS BIGINT) AS w FROM f GROUP BY 1) g ON g.review_id = t.review_id", F_, T_, E_)
def review_detail(spark, d):
    g = findings(spark, d, "review_id", "severity").groupBy("review_id").agg(F.count("*").alias("n"), F.max(S.severity_weight(F.col("severity"))).cast("long").alias("w"))
    e = episodes(spark, d, "score").withColumnRenamed("task_id", "review_id")
    x = tasks(spark, d, "status").join(e, "review_id", "left").join(g, "review_id", "left")
    return x.select("review_id", "status", "score", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("w", F.lit(0)).alias("worst"))
