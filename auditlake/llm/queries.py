"""The queries pN_... of this subpackage over the tables of a folder, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, chunking, handwritten, mixing, mojibake, neardup, neighbours, parsing, secrets
from auditlake.session import spread, table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized file."""
    return chunking.split_oversized(table(spark, sf_dir, "code_files"), ["review_id", "file_seq"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that were cut."""
    return p1_pieces(spark, sf_dir).where("piece_no = 0 and n_pieces > 1").select("review_id", "file_seq")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file is that isn't hand-written."""
    return handwritten.not_handwritten(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "review_tasks"), table(spark, sf_dir, "known_libs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that aren't hand-written."""
    return p2_kinds(spark, sf_dir).select("review_id", "file_seq").distinct()


def p2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the classifiers on repositories held out."""
    return handwritten.validation(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "review_tasks"), table(spark, sf_dir, "known_libs"))


def _credential_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    files, results = table(spark, sf_dir, "code_files"), table(spark, sf_dir, "agent_results")
    return [
        ("code_files", files.select("review_id", F.col("file_seq").cast("long").alias("record_seq"), F.col("content").alias("text"), "path")),
        ("agent_results", results.select("review_id", F.col("arrival_seq").cast("long").alias("record_seq"), F.col("code_snippet").alias("text"), F.col("file_path").alias("path"))),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which a credential begins."""
    parts = [secrets.find_lines(df, ["review_id", "record_seq"], "text", "path").select(F.lit(name).alias("record_table"), "review_id", "record_seq", "line_no") for name, df in _credential_sources(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, masked."""
    parts = [secrets.find_credentials(df, ["review_id", "record_seq"], "text", "path").select(F.lit(name).alias("record_table"), "review_id", "record_seq", "redacted").distinct() for name, df in _credential_sources(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of records that report one defect again."""
    return neardup.near_pairs(table(spark, sf_dir, "agent_results")).select(F.col("a").alias("arrival_seq_a"), F.col("b").alias("arrival_seq_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each record that is reported again."""
    g = neardup.near_groups(table(spark, sf_dir, "agent_results"))
    return g.select(F.col("node").alias("arrival_seq"), F.col("component").alias("group_id"), "n_members", "n_links")


def p5_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that don't parse, with the line of the furthest failure and its cause."""
    return parsing.invalid_files(table(spark, sf_dir, "code_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that don't parse."""
    return p5_failures(spark, sf_dir).select("review_id", "file_seq").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of files that don't parse, by repository and language."""
    return parsing.rates(table(spark, sf_dir, "code_files"), handwritten.repos_of_reviews(table(spark, sf_dir, "review_tasks")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of which one is among the other's five most similar records."""
    return neighbours.nearest_pairs(table(spark, sf_dir, "semantic_memories"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, in schedule order by (slot, source_offset)."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a mix as large as the corpus, which sources with few documents can't fill to their targets."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets, total=mixing.CORPUS), targets)


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their text given back."""
    return mojibake.find_garbled(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents."""
    return p9_repaired(spark, sf_dir).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_pieces, p2_found, p2_kinds, p2_validation, p3_found, p3_redacted, p4_found, p4_groups, p5_found, p5_failures, p5_rates, p6_found, p7_ids, p8_mix, p8_shares, p8_corpus_shares, p9_found, p9_repaired]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT review_id, file_seq FROM code_files WHERE length(content) > 8000",
        "p4_found": r"""
            WITH f AS (SELECT DISTINCT arrival_seq, title, description, file_path, coalesce(line_start, 0) AS line FROM agent_results WHERE description <> '' AND file_path IS NOT NULL),
            w AS (SELECT arrival_seq, line, lower(regexp_extract(file_path, '([^/\\]*)$', 1)) AS base, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || description), '[a-z0-9_]+')) AS ws FROM f)
            SELECT a.arrival_seq AS arrival_seq_a, b.arrival_seq AS arrival_seq_b FROM w a JOIN w b ON a.base = b.base AND a.arrival_seq < b.arrival_seq AND (a.line = 0 OR b.line = 0 OR abs(a.line - b.line) <= 8)
            WHERE 10 * len(list_intersect(a.ws, b.ws)) >= 7 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
        """,
    }
