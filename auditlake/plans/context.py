"""Queries that assemble context."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import context as O
from auditlake.operators import findings as N
from auditlake.plans.base import F_, K_, files, findings, knowledge, query
from auditlake.plans.findings import _ROUTES, _SIGNALS
from auditlake.session import spread


@query()
def chunk_boundary(spark, d):
    return O.boundary_chunks(spread(files(spark, d, "path", "content")), ["review_id", "file_seq"])


@query("SELECT knowledge_type, string_agg(pos || '. ' || coalesce(title, ''), chr(10) ORDER BY pos) AS text FROM (SELECT knowledge_type, title, row_number() OVER (PARTITION BY knowledge_type ORDER BY ts DESC NULLS LAST, id) AS pos FROM k WHERE knowledge_type IN ('rule', 'best_practice')) WHERE pos <= CASE knowledge_type WHEN 'rule' THEN 10 ELSE 5 END GROUP BY 1", K_)
def knowledge_context(spark, d):
    k = knowledge(spark, d, "knowledge_type", "title", "ts")
    order = [F.desc_nulls_last("ts"), F.col("id")]
    rules = O.numbered(k.where("knowledge_type = 'rule'"), ["knowledge_type"], order, F.col("title"), 10)
    return rules.unionByName(O.numbered(k.where("knowledge_type = 'best_practice'"), ["knowledge_type"], order, F.col("title"), 5))


@query("SELECT review_id, target_agent, string_agg(pos || '. from ' || source_agent || ': ' || signal_type || ' in ' || coalesce(file_path, '-'), chr(10) ORDER BY pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY review_id, target_agent ORDER BY arrival_seq) AS pos FROM g) WHERE pos <= 10 GROUP BY 1, 2", F_, _ROUTES, _SIGNALS)
def signal_text(spark, d):
    s = N.signals(findings(spark, d, "review_id", "agent_type", "category", "severity", "file_path"))
    line = F.concat(F.lit("from "), "source_agent", F.lit(": "), "signal_type", F.lit(" in "), F.coalesce("file_path", F.lit("-")))
    return O.numbered(s, ["review_id", "target_agent"], [F.col("arrival_seq")], line, 10)


@query("SELECT review_id, string_agg(title, '; ' ORDER BY arrival_seq) AS summary FROM (SELECT review_id, title, arrival_seq, row_number() OVER (PARTITION BY review_id ORDER BY arrival_seq) AS pos FROM f WHERE title IS NOT NULL) WHERE pos <= 3 GROUP BY 1", F_)
def block_summary(spark, d):
    f = N.top_per(findings(spark, d, "review_id", "title").where("title is not null"), ["review_id"], [F.col("arrival_seq")], 10)
    g = f.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("r"))  # at most ten
    return g.select("review_id", O.joined_summary(F.transform("r", lambda r: r["title"])).alias("summary"))
