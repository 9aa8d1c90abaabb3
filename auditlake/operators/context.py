"""Context texts: numbered lists, chunks at definitions, summaries of chunks."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import language_of
from auditlake.operators.findings import top_per
from auditlake.operators.text import packed


def numbered(df: DataFrame, key: list[str], order: list[Column], line: Column, most: int) -> DataFrame:
    """(*key, text): the first ``most`` rows of each key as a numbered list."""
    top = top_per(df.withColumn("_line", line), key, order, most, "_pos")
    g = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", F.concat(F.col("_pos").cast("string"), F.lit(". "), F.coalesce("_line", F.lit(""))).alias("x")))).alias("r"))  # at most ``most`` rows
    return g.select(*key, F.array_join(F.transform("r", lambda r: r["x"]), "\n").alias("text"))


def cut_at_definitions(text: str, most: int) -> list[tuple[int, int, int]]:
    """(first line, last line, tokens): chunks that end where definitions of the margin begin, within ``most`` tokens unless one definition is larger.

    The chunks cover the file once. A file that doesn't parse is packed line by line.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return packed(text, most)
    lines = text.split("\n")
    cost = [max(1, len(x) // 4) for x in lines]
    starts = sorted({1, *(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))})
    out, first, tokens = [], 1, 0
    for a, b in zip(starts, [*starts[1:], len(lines) + 1]):
        block = sum(cost[a - 1 : b - 1])
        if a > first and tokens + block > most:
            out.append((first, a - 1, tokens))
            first, tokens = a, 0
        tokens += block
    out.append((first, len(lines), tokens))
    return out


def boundary_chunks(files: DataFrame, keep: list[str], most: int = 500) -> DataFrame:
    """(*keep, chunk_no, start_line, end_line, tokens): Python at its definitions, the rest line by line."""
    kinds, n = dict(files.dtypes), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for r, (lang, text) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                for i, c in enumerate(cut_at_definitions(text, most) if lang == "python" else packed(text, most)):
                    rows.append(r)
                    parts.append((i, *c))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), *(pa.array([p[i] for p in parts], pa.int32()) for i in range(4))], names=[*keep, "chunk_no", "start_line", "end_line", "tokens"])

    part = files.where(F.length("content") > 0).select(*keep, language_of(F.col("path")).alias("_lang"), "content")
    return part.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", chunk_no int, start_line int, end_line int, tokens int")


def joined_summary(parts: Column, most: int = 10, shown: int = 3) -> Column:
    """The fallback summary of a file: of its first ``most`` chunk summaries the first ``shown``."""
    return F.array_join(F.slice(F.slice(parts, 1, most), 1, shown), "; ")
