"""Queries on findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import findings as O
from auditlake.operators.memory import frequencies
from auditlake.operators.records import last_value, merged_maps
from auditlake.plans.base import E_, F_, PLACE, T_, WEIGHT, episodes, files, findings, long, query, tasks
from auditlake.session import table

_KEPT = f"d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY review_id, file_path, category, {PLACE} ORDER BY arrival_seq) = 1)"
_COUNTS = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"
_SCORES = f"s AS (SELECT review_id, {_COUNTS} FROM d GROUP BY review_id), z AS (SELECT *, CAST(floor((least(200, greatest(0, 200 - 20 * critical - 10 * high - 3 * medium - low)) + 1) / 2) AS BIGINT) AS tenths FROM s)"
_SCORE = "CAST(CAST(tenths AS DECIMAL(10, 1)) * 0.1 AS DECIMAL(4, 1))"


@query("SELECT count(*) AS n_rows, count(DISTINCT arrival_seq) AS n_records FROM agent_results")
def redelivered(spark, d):
    return table(spark, d, "agent_results").groupBy("arrival_seq").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_records"))


@query("SELECT review_id, arrival_seq, agent_type, coalesce(lower(severity), 'info') AS severity, coalesce(nullif(file_path, ''), 'unknown') AS file_path, nullif(line_start, 0) AS line_start, coalesce(nullif(category, ''), 'other') AS category, coalesce(title, '') AS title FROM f", F_)
def normalize_findings(spark, d):
    return O.normalized(findings(spark, d, "review_id", "agent_type", "severity", "file_path", "line_start", "category", "title"))


@query("SELECT arrival_seq, CASE WHEN source = 'llm' AND agent_type <> 'style' AND (severity IS NULL OR severity NOT IN ('critical', 'high', 'medium', 'low', 'info')) THEN 'medium' ELSE severity END AS severity FROM f", F_)
def severity_sanitize(spark, d):
    f = findings(spark, d, "severity", "source", "agent_type")
    return f.select("arrival_seq", F.when((F.col("source") == "llm") & (F.col("agent_type") != "style") & ~S.in_domain(F.col("severity")), F.lit("medium")).otherwise(F.col("severity")).alias("severity"))


@query("SELECT review_id, position, arrival_seq FROM (SELECT review_id, arrival_seq, row_number() OVER (PARTITION BY review_id ORDER BY CASE WHEN triggered_by IS NOT NULL THEN 6 ELSE CASE agent_type WHEN 'style' THEN 1 WHEN 'security' THEN 2 WHEN 'architecture' THEN 3 WHEN 'performance' THEN 4 WHEN 'refactor' THEN 5 ELSE 7 END END, arrival_seq) AS position FROM f)", F_)
def findings_union(spark, d):
    return O.united(findings(spark, d, "review_id", "agent_type", "triggered_by")).transform(long("position"))


@query(f"SELECT review_id, min(arrival_seq) AS arrival_seq, count(*) AS n_merged FROM f GROUP BY review_id, file_path, category, {PLACE}", F_)
def finding_dedup(spark, d):
    return O.kept(findings(spark, d, "review_id", "file_path", "category", "line_start", "title"))


@query(f"SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY {WEIGHT} DESC, arrival_seq) AS rank_no, arrival_seq, CAST({WEIGHT} AS BIGINT) AS weight FROM f", F_)
def severity_rank(spark, d):
    return O.ranked(findings(spark, d, "review_id", "severity")).transform(long("rank_no", "weight"))


@query(f"SELECT review_id, {_COUNTS}, count(*) FILTER (severity IS NULL OR severity NOT IN ('critical', 'high', 'medium', 'low')) AS info FROM f GROUP BY review_id", F_)
def severity_counts(spark, d):
    return O.bucket_counts(findings(spark, d, "review_id", "severity"))


@query(f"SELECT review_id, {_COUNTS}, count(*) FILTER (severity = 'info') AS info FROM f GROUP BY review_id", F_)
def severity_counts_strict(spark, d):
    return O.bucket_counts(findings(spark, d, "review_id", "severity"), unknown_as_info=False)


@query("SELECT review_id, coalesce(severity, 'info') AS severity, count(*) AS n FROM f GROUP BY 1, 2", F_)
def severity_counts_open(spark, d):
    return findings(spark, d, "review_id", "severity").groupBy("review_id", F.coalesce("severity", F.lit("info")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT review_id, coalesce(category, 'other') AS category, count(*) AS n FROM f GROUP BY 1, 2", F_)
def category_counts(spark, d):
    return findings(spark, d, "review_id", "category").groupBy("review_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(agent_type, 'unknown') AS agent_type, count(*) AS n FROM f GROUP BY 1", F_)
def agent_counts(spark, d):
    return findings(spark, d, "agent_type").groupBy(F.coalesce("agent_type", F.lit("unknown")).alias("agent_type")).agg(F.count("*").alias("n"))


@query(f"SELECT review_id, critical, high, medium, low, {_SCORE} AS score FROM z", F_, _KEPT, _SCORES)
def review_score(spark, d):
    return O.scored(findings(spark, d, "review_id", "file_path", "category", "line_start", "title", "severity"))


@query(f"SELECT review_id, score, CASE WHEN score >= 8 THEN 'good' WHEN score >= 6 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN score < 5 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS decision FROM (SELECT review_id, {_SCORE} AS score FROM z)", F_, _KEPT, _SCORES)
def score_band(spark, d):
    s = review_score(spark, d).select("review_id", "score")
    band = F.when(F.col("score") >= 8, "good").when(F.col("score") >= 6, "fair").otherwise("poor")
    return s.select("review_id", "score", band.alias("band"), F.when(F.col("score") < 5, "REQUEST_CHANGES").otherwise("COMMENT").alias("decision"))


@query("SELECT task_id, CASE WHEN coalesce(score, 0) = 0 THEN CAST(greatest(0, 200 - 20 * coalesce(severity_counts['critical'], 0) - 10 * coalesce(severity_counts['high'], 0) - 3 * coalesce(severity_counts['medium'], 0) - coalesce(severity_counts['low'], 0)) AS DOUBLE) / 20 ELSE score END AS score FROM e", E_)
def score_recompute(spark, d):
    n = lambda s: F.coalesce(F.try_element_at("severity_counts", F.lit(s)), F.lit(0))
    raw = F.greatest(F.lit(0), F.lit(200) - sum(n(s) * w for s, w in S.DEDUCTIONS.items())).cast("double") / 20
    return episodes(spark, d, "score", "severity_counts").select("task_id", F.when(F.coalesce("score", F.lit(0.0)) == 0, raw).otherwise(F.col("score")).alias("score"))


@query("SELECT * FROM (SELECT review_id, category, n, row_number() OVER (PARTITION BY review_id ORDER BY n DESC, first_seq) AS pos FROM (SELECT review_id, coalesce(category, 'other') AS category, count(*) AS n, min(arrival_seq) AS first_seq FROM f GROUP BY 1, 2)) WHERE pos <= 5", F_)
def top_categories(spark, d):
    g = findings(spark, d, "review_id", "category").groupBy("review_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first_seq"))
    return O.top_per(g, ["review_id"], [F.desc("n"), F.col("first_seq")], 5).drop("first_seq").transform(long("pos"))


@query("SELECT * FROM (SELECT review_id, title, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS pos FROM f WHERE severity IN ('critical', 'high') AND title <> '') WHERE pos <= 10", F_)
def key_facts(spark, d):
    f = findings(spark, d, "review_id", "title", "severity").where("severity in ('critical', 'high') and title <> ''")
    return O.top_per(f, ["review_id"], [F.col("arrival_seq")], 10).select("review_id", "title", "pos").transform(long("pos"))


@query(f"SELECT category, count(*) AS n, CAST(max({WEIGHT}) AS BIGINT) AS max_weight, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT title) AS n_titles, count(DISTINCT suggestion) AS n_suggestions FROM f WHERE category IS NOT NULL GROUP BY category", F_)
def procedural_rollup(spark, d):
    # Two levels, so that no task holds all titles of a frequent category.
    f = findings(spark, d, "category", "severity", "created_at", "title", "suggestion").where("category is not null")
    base = f.groupBy("category").agg(F.count("*").alias("n"), F.max(S.severity_weight(F.col("severity"))).cast("long").alias("max_weight"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    distinct = lambda c, name: f.where(F.col(c).isNotNull()).select("category", c).distinct().groupBy("category").agg(F.count("*").alias(name))
    out = base.join(distinct("title", "n_titles"), "category", "left").join(distinct("suggestion", "n_suggestions"), "category", "left")
    return out.fillna(0, ["n_titles", "n_suggestions"])


_FREQ = "p AS (SELECT category, title, count(*) AS title_n, min(arrival_seq) AS first_seq FROM f WHERE category IS NOT NULL GROUP BY 1, 2), q AS (SELECT category, CAST(sum(title_n) AS BIGINT) AS n, min(first_seq) AS seen FROM p GROUP BY 1 ORDER BY n DESC, seen LIMIT 10)"


@query("SELECT category, n, title, title_n, title_rank FROM (SELECT p.category, q.n, p.title, p.title_n, row_number() OVER (PARTITION BY p.category ORDER BY title_n DESC, first_seq) AS title_rank FROM p JOIN q ON p.category = q.category) WHERE title_rank <= 3", F_, _FREQ)
def frequent_issues(spark, d):
    return frequencies(findings(spark, d, "category", "title").where("category is not null"), "category", "title", 10, 3, "arrival_seq").transform(long("title_rank"))


@query("SELECT suggestion, count(*) AS n FROM f WHERE category = 'sql_injection' AND suggestion IS NOT NULL GROUP BY suggestion", F_)
def suggestions_for(spark, d):
    return findings(spark, d, "category", "suggestion").where("category = 'sql_injection' and suggestion is not null").groupBy("suggestion").agg(F.count("*").alias("n"))


@query("SELECT g.category, g.n, left(b.suggestion, 150) AS suggestion FROM (SELECT category, count(*) AS n, min(arrival_seq) AS seen FROM f WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, seen LIMIT 10) g JOIN (SELECT category, suggestion FROM (SELECT category, suggestion, count(*) AS n, min(arrival_seq) AS s FROM f WHERE category IS NOT NULL AND suggestion IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, s) = 1) b ON g.category = b.category", F_)
def frequency_context(spark, d):
    f = findings(spark, d, "category", "suggestion").where("category is not null")
    top = f.groupBy("category").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("seen")).orderBy(F.desc("n"), "seen").limit(10)
    per = f.where("suggestion is not null").groupBy("category", "suggestion").agg(F.count("*").alias("m"), F.min("arrival_seq").alias("s"))
    best = per.groupBy("category").agg(F.max_by("suggestion", F.struct("m", -F.col("s"))).alias("suggestion"))
    return best.join(F.broadcast(top), "category").select("category", "n", F.left("suggestion", F.lit(150)).alias("suggestion"))


@query("SELECT * FROM (SELECT review_id, arrival_seq, file_path, line_start, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS pos FROM f WHERE severity IN ('critical', 'high') AND file_path <> '' AND line_start > 0) WHERE pos <= 5", F_)
def inline_top5(spark, d):
    f = findings(spark, d, "review_id", "severity", "file_path", "line_start").where("severity in ('critical', 'high') and file_path <> '' and line_start > 0")
    return O.top_per(f, ["review_id"], [F.col("arrival_seq")], 5).select("review_id", "arrival_seq", "file_path", "line_start", "pos").transform(long("pos"))


def _top(spark, d, n):
    return O.ranked(findings(spark, d, "review_id", "severity")).where(F.col("rank_no") <= n).select("review_id", "arrival_seq", "rank_no").transform(long("rank_no"))


def _top_sql(n):
    return f"SELECT * FROM (SELECT review_id, arrival_seq, row_number() OVER (PARTITION BY review_id ORDER BY {WEIGHT} DESC, arrival_seq) AS rank_no FROM f) WHERE rank_no <= {n}"


@query(_top_sql(10), F_)
def note_top10(spark, d):
    return _top(spark, d, 10)


@query(_top_sql(20), F_)
def top20(spark, d):
    return _top(spark, d, 20)


@query(f"SELECT arrival_seq, {WEIGHT}::BIGINT AS weight FROM f ORDER BY weight DESC, arrival_seq LIMIT 50", F_)
def top_findings(spark, d):
    f = findings(spark, d, "severity").select("arrival_seq", S.severity_weight(F.col("severity")).cast("long").alias("weight"))
    return f.orderBy(F.desc("weight"), "arrival_seq").limit(50)


@query("SELECT severity, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT coalesce(severity, 'none') AS severity, count(*) AS n FROM f GROUP BY 1)", F_)
def severity_facet(spark, d):
    g = findings(spark, d, "severity").groupBy(F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per severity


@query("SELECT review_id, CASE WHEN triggered_by IS NOT NULL THEN 'collaboration' WHEN source = 'skill' THEN coalesce(skill_name, 'skill') ELSE agent_type END AS producer, count(*) AS n FROM f GROUP BY 1, 2", F_)
def producer_counts(spark, d):
    p = F.when(F.col("triggered_by").isNotNull(), "collaboration").when(F.col("source") == "skill", F.coalesce("skill_name", F.lit("skill"))).otherwise(F.col("agent_type"))
    return findings(spark, d, "review_id", "triggered_by", "source", "skill_name", "agent_type").groupBy("review_id", p.alias("producer")).agg(F.count("*").alias("n"))


@query("SELECT t.review_id, s.step_no, s.agent_type, coalesce(g.n, 0) AS n FROM t CROSS JOIN (VALUES (1::BIGINT, 'style'), (2, 'security'), (3, 'architecture'), (4, 'performance'), (5, 'refactor')) s(step_no, agent_type) LEFT JOIN (SELECT review_id, agent_type, count(*) AS n FROM f GROUP BY 1, 2) g ON g.review_id = t.review_id AND g.agent_type = s.agent_type", F_, T_)
def agent_timeline(spark, d):
    steps = F.posexplode(F.array(*map(F.lit, O.PRODUCERS))).alias("step_no", "agent_type")
    t = tasks(spark, d, "status").select("review_id", steps).withColumn("step_no", (F.col("step_no") + 1).cast("long"))
    g = findings(spark, d, "review_id", "agent_type").groupBy("review_id", "agent_type").agg(F.count("*").alias("n"))
    return t.join(g, ["review_id", "agent_type"], "left").fillna(0, ["n"])


@query("SELECT arrival_seq, 'skill' AS source, coalesce(skill_name, 'unnamed') AS skill_name, coalesce(agent_type, 'skill') AS agent_type, coalesce(nullif(file_path, ''), 'unknown') AS file_path FROM f WHERE source = 'skill'", F_)
def skill_tag(spark, d):
    f = findings(spark, d, "source", "skill_name", "agent_type", "file_path").where("source = 'skill'")
    return f.select("arrival_seq", F.lit("skill").alias("source"), F.coalesce("skill_name", F.lit("unnamed")).alias("skill_name"), F.coalesce("agent_type", F.lit("skill")).alias("agent_type"), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("unknown")).alias("file_path"))


_ROUTES = "r(agent_type, category, target_agent, signal_type) AS (VALUES " + ", ".join(str(x) for x in O.ROUTES) + ")"
_SIGNALS = "g AS (SELECT * FROM (SELECT f.review_id, f.arrival_seq, f.agent_type AS source_agent, r.target_agent, r.signal_type, f.file_path, row_number() OVER (PARTITION BY f.review_id, f.agent_type ORDER BY f.arrival_seq) AS seq FROM f JOIN r ON f.agent_type = r.agent_type AND f.category = r.category WHERE lower(f.severity) IN ('critical', 'high')) WHERE seq <= 10)"


@query("SELECT * FROM g", F_, _ROUTES, _SIGNALS)
def signal_route(spark, d):
    return O.signals(findings(spark, d, "review_id", "agent_type", "category", "severity", "file_path")).transform(long("seq"))


@query("SELECT review_id, target_agent, count(*) AS n, min(arrival_seq) AS first_seq FROM g GROUP BY 1, 2", F_, _ROUTES, _SIGNALS)
def signal_groups(spark, d):
    return signal_route(spark, d).groupBy("review_id", "target_agent").agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first_seq"))


@query("SELECT review_id, file_seq, path, pos FROM (SELECT c.review_id, c.file_seq, c.path, row_number() OVER (PARTITION BY c.review_id ORDER BY c.file_seq) AS pos FROM (SELECT * FROM code_files QUALIFY row_number() OVER (PARTITION BY review_id, file_seq ORDER BY fetched_at DESC) = 1) c WHERE EXISTS (SELECT 1 FROM g WHERE g.review_id = c.review_id AND g.file_path = c.path)) WHERE pos <= 5", F_, _ROUTES, _SIGNALS)
def signal_files_semi(spark, d):
    hit = signal_route(spark, d).select("review_id", F.col("file_path").alias("path")).distinct()
    f = files(spark, d, "path").join(hit, ["review_id", "path"], "left_semi")
    return O.top_per(f, ["review_id"], [F.col("file_seq")], 5).select("review_id", "file_seq", "path", "pos").transform(long("pos"))


@query("SELECT arrival_seq, path, row_number() OVER (PARTITION BY arrival_seq ORDER BY path) AS pos FROM (SELECT f.arrival_seq, c.path FROM f JOIN (SELECT DISTINCT review_id, path, regexp_extract(path, '([^/\\\\]+?)(\\.[^./\\\\]+)?$', 1) AS stem FROM code_files WHERE path IS NOT NULL) c ON f.review_id = c.review_id WHERE f.category IN ('cyclic_dependency', 'layer_violation', 'tight_coupling') AND length(c.stem) > 3 AND (contains(f.description, c.path) OR contains(f.description, c.stem))) QUALIFY pos <= 5", F_)
def cycle_files(spark, d):
    """The first five files that the text of a finding on the graph names."""
    f = findings(spark, d, "review_id", "category", "description").where("category in ('cyclic_dependency', 'layer_violation', 'tight_coupling')")
    c = table(spark, d, "code_files").where("path is not null").select("review_id", "path", F.regexp_extract("path", r"([^/\\]+?)(\.[^./\\]+)?$", 1).alias("stem")).distinct().where("length(stem) > 3")
    met = f.join(c, "review_id").where(F.col("description").contains(F.col("path")) | F.col("description").contains(F.col("stem"))).select("arrival_seq", "path")
    return O.top_per(met, ["arrival_seq"], [F.col("path")], 5).transform(long("pos"))


@query("SELECT skill_name, severity, count(*) AS n FROM (SELECT skill_name, coalesce(lower(severity), 'info') AS severity FROM f WHERE skill_name IS NOT NULL) GROUP BY 1, 2", F_)
def skill_severity(spark, d):
    f = findings(spark, d, "skill_name", "severity").where("skill_name is not null")
    return f.groupBy("skill_name", F.coalesce(F.lower("severity"), F.lit("info")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def dict_merge_reduce(spark, d):
    return merged_maps(table(spark, d, "events"), "user_id", "event_type", "value", "event_id")


@query("SELECT review_id, max_by(status, updated_at) AS status FROM review_tasks GROUP BY 1")
def last_value_reduce(spark, d):
    return last_value(table(spark, d, "review_tasks"), ["review_id"], "status", "updated_at")


@query("SELECT review_id, 'Review ' || review_id || ': ' || n || ' findings, ' || critical || ' critical, ' || high || ' high; most in ' || category AS summary FROM (SELECT review_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM f GROUP BY 1) JOIN (SELECT review_id, coalesce(category, 'other') AS category FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY count(*) DESC, min(arrival_seq)) = 1) USING (review_id)", F_)
def rule_summary(spark, d):
    f = findings(spark, d, "review_id", "category", "severity")
    per = f.groupBy("review_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.min("arrival_seq").alias("s"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"))
    g = per.groupBy("review_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h"), F.max_by("category", F.struct("n", -F.col("s"))).alias("category"))
    return g.select("review_id", F.concat(F.lit("Review "), "review_id", F.lit(": "), "n", F.lit(" findings, "), "c", F.lit(" critical, "), "h", F.lit(" high; most in "), "category").alias("summary"))
