"""Files from requests, folders, hosts and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scalars import language_of
from auditlake.operators.text import rebuilt_from_patch

FILE = "review_id string, file_seq int, path string, content string"
# Suffixes that are read, folders that are passed over, limits of one review.
SUFFIXES = [".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".java"]
IGNORED = ["node_modules", "vendor", "dist", "build", ".git", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", "docs", "tests", "test", "examples", "example"]
MOST_FILES, MOST_CHARS, DEEPEST = 50, 1_048_576, 5


def inline(spark: SparkSession, review_id: str, files: list[dict]) -> DataFrame:
    """The files of one request, in order; one with a blank path or content is dropped."""
    kept = [f for f in files if (f.get("path") or "").strip() and (f.get("content") or "").strip()]
    return spark.createDataFrame([(review_id, i, f["path"], f["content"]) for i, f in enumerate(kept)], FILE)


def supported(path: Column) -> Column:
    """A code suffix, outside the folders passed over."""
    parts = F.split(F.lower(path), "/")
    return (language_of(path) != "unknown") & ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))


def folder(spark: SparkSession, root: str, review_id: str) -> DataFrame:
    """The code files below a folder, at most five levels deep, each path once; bytes that aren't UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", r"^\w+:/*", "/")
    rel = F.regexp_replace(at, "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in "/" + root.strip("/")) + "/", "")
    x = raw.select(rel.alias("path"), text_of(F.col("content")).alias("content")).where(supported(F.col("path")) & (F.size(F.split("path", "/")) <= DEEPEST))
    return x.dropDuplicates(["path"]).select(F.lit(review_id).alias("review_id"), F.xxhash64("path").alias("file_key"), "path", "content")


def text_of(data: Column) -> Column:
    """Bytes as text, with a sign for what isn't UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.make_valid_utf8(data.cast("string")))


def from_base64(encoded: Column) -> Column:
    """The text of a contents API's answer, which breaks its lines."""
    return text_of(F.unbase64(F.regexp_replace(encoded, r"\s", "")))


def changed(changes: DataFrame, full: DataFrame) -> DataFrame:
    """(review_id, path, content) of changes(review_id, path, status, patch): not removed, code, from the patch, else the full file(review_id, path, content)."""
    live = changes.where((F.col("status") != "removed") & supported(F.col("path")))
    part = F.nullif(rebuilt_from_patch(F.col("patch")), F.lit(""))
    return live.join(full, ["review_id", "path"], "left").select("review_id", "path", F.coalesce(part, F.col("content")).alias("content")).where("content is not null")


def merged(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    """Requested files win over fetched ones of the same path."""
    return requested.unionByName(fetched.join(requested, ["review_id", "path"], "left_anti"), allowMissingColumns=True)


def within_limits(files: DataFrame) -> DataFrame:
    """(review_id, accepted, reason): a review's files against the limits."""
    g = files.groupBy("review_id").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("most"))
    reason = F.when(F.col("n") > MOST_FILES, "too many files").when(F.col("most") > MOST_CHARS, "file too large")
    return g.select("review_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def from_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store kept as JSON lines; rows that can't be read have nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
