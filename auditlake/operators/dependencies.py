"""Dependency manifests: parsed, linted, joined with advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.text import exploded


def parsed(files: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, line_no, name, version, ecosystem) of requirements files, go.mod and package.json among files(path, content)."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    lines = exploded(files.withColumn("_f", name).where(F.col("_f").rlike(r"^(requirements.*\.txt|go\.mod)$")), [*keep, "_f"])
    bare = F.trim(F.regexp_replace("line", r"\s*(#|//).*$", ""))
    py = lines.where(F.col("_f") != "go.mod").select(*keep, "line_no", F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("name"), F.regexp_extract(bare, r"(?:==|>=|<=|~=|!=|>|<)\s*([\w.*+!-]+)", 1).alias("version"), F.lit("PyPI").alias("ecosystem")).where("name <> ''")
    go = lines.where(F.col("_f") == "go.mod").select(*keep, "line_no", F.regexp_extract(bare, r"^(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v", 1).alias("name"), F.regexp_extract(bare, r"\s(v[\w.+-]+)", 1).alias("version"), F.lit("Go").alias("ecosystem")).where("name <> ''")
    both = F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies",)])
    dev = F.coalesce(F.from_json(F.get_json_object("content", "$.devDependencies"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    npm = files.where(name == "package.json").select(*keep, F.explode(F.concat(F.map_entries(both), F.map_entries(dev))).alias("e"))
    npm = npm.select(*keep, F.lit(0).alias("line_no"), F.col("e.key").alias("name"), F.col("e.value").alias("version"), F.lit("npm").alias("ecosystem"))
    return py.unionByName(go).unionByName(npm)


def linted(deps: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, name, category, severity): named twice, without version, loosely pinned."""
    v = F.coalesce("version", F.lit(""))
    rules = F.array(F.when((v == "") | (v == "*") | (v == "latest"), F.struct(F.lit("unpinned").alias("category"), F.lit("high").alias("severity"))), F.when(v.startswith("^") | v.startswith("~"), F.struct(F.lit("loose_version").alias("category"), F.lit("low").alias("severity"))))
    one = deps.select(*keep, "name", F.explode(F.array_compact(rules)).alias("r")).select(*keep, "name", "r.*")
    twice = deps.groupBy(*keep, F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1").select(*keep, "name", F.lit("duplicate").alias("category"), F.lit("medium").alias("severity"))
    return one.unionByName(twice)


def repeated(deps: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, name, line_no, occurrence, first_line): the second and later entries of a name, whatever its case."""
    w = Window.partitionBy(*keep, "name").orderBy("line_no")
    x = deps.select(*keep, F.lower("name").alias("name"), "line_no")
    return x.withColumns({"occurrence": F.row_number().over(w), "first_line": F.min("line_no").over(w)}).where("occurrence > 1")


def broken_manifests(files: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, line_no, category, severity): package.json files that are no JSON."""
    bad = files.where(F.col("path").rlike(r"(^|[/\\])package\.json$") & (F.length("content") > 0) & F.expr("try_parse_json(content) is null"))
    return bad.select(*keep, F.lit(1).alias("line_no"), F.lit("invalid_json").alias("category"), F.lit("high").alias("severity"))


def too_indirect(files: DataFrame, keep: list[str], most: int = 20) -> DataFrame:
    """go.mod files with more than ``most`` indirect requirements."""
    n = F.size(F.split("content", "// indirect")) - 1
    return files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select(*keep, n.alias("n_indirect")).where(F.col("n_indirect") > most)


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with an advisory(name, version, ecosystem, advisory_id, cvss_v3): high if it has a score vector, else medium."""
    return deps.join(advisories, ["name", "version", "ecosystem"]).withColumn("severity", F.when(F.col("cvss_v3").isNotNull(), "high").otherwise("medium"))


SCANNER = "results array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string, lines: string>>>"


def scanner_findings(answers: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, file_path, line_start, line_end, category, title, severity) of an external scanner's JSON answers(exit_code, body); exit codes 0 and 1 are results."""
    r = answers.where(F.col("exit_code").isin(0, 1)).select(*keep, F.explode(F.from_json("body", SCANNER)["results"]).alias("r"))
    severity = F.when(F.col("r.extra.severity") == "ERROR", "high").when(F.col("r.extra.severity") == "WARNING", "medium").when(F.col("r.extra.severity") == "INFO", "low").otherwise("info")
    return r.select(*keep, F.col("r.path").alias("file_path"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), F.col("r.check_id").alias("category"), F.left("r.extra.message", F.lit(255)).alias("title"), severity.alias("severity"))
