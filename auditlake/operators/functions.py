"""Functions of source files: length, parameters, complexity, nesting; and their thresholds as expressions.

Python is read by its own parser; the languages with braces by a scanner of keywords and braces (an approximation: strings and comments
are blanked first, every logical or comparing operator counts). A file that doesn't parse has no functions and one row in ``unparsed``.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import language_of, lookup

FUNCTION = "name string, start_line int, end_line int, n_lines int, n_params int, n_named int, complexity int, nesting int"
# Lines allowed by language; steps of complexity and parameters.
MOST_LINES = {"python": 50, "go": 80, "typescript": 60, "javascript": 50, "java": 60}
BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)
HEAD = {
    "go": re.compile(r"\bfunc\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\((?P<args>[^)]{0,2000})\)[^{;\n]{0,2000}\{"),
    "java": re.compile(r"(?<![\w.])(?!(?:if|for|while|switch|catch|synchronized|return|new|else|do|try)\b)[\w<>\[\],?.@]{1,200}\s+(?P<name>(?!(?:if|for|while|switch|catch|synchronized)\b)\w{1,200})\s*\((?P<args>[^()]{0,2000})\)\s*(?:throws [\w., ]+)?\{"),
    "script": re.compile(r"\bfunction\s*\*?\s*(?P<name>\w*)\s*(?:<[^>(]*>)?\((?P<args>[^)]{0,2000})\)[^{;\n]{0,2000}\{|\b(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s*)?\((?P<args2>[^)]{0,2000})\)[^={\n]{0,500}=>\s*\{|^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<name3>(?!(?:if|for|while|switch|catch|function|return|constructor)\b)\w+)\s*\((?P<args3>[^)]{0,2000})\)[^{;\n=]{0,500}\{", re.M),
}
BRANCH = re.compile(r"\b(?:if|for|while|case|catch|select)\b|&&|\|\||\?(?![.?:])")


class _Complexity(ast.NodeVisitor):
    def __init__(self):
        self.n = 1

    def generic_visit(self, node):
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case, ast.Try)):
            self.n += 1
        elif isinstance(node, ast.Match):
            self.n += 1
        elif isinstance(node, ast.BoolOp):
            self.n += len(node.values) - 1
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            self.n += 1
        super().generic_visit(node)


def _nesting(node: ast.AST, depth: int = 0) -> int:
    most = depth
    for child in ast.iter_child_nodes(node):
        inner = isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match))
        most = max(most, _nesting(child, depth + inner))
    return most


def python_functions(text: str) -> list[tuple] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]]
            c = _Complexity()
            c.generic_visit(node)
            end = node.end_lineno or node.lineno
            out.append((node.name, node.lineno, end, end - node.lineno + 1, sum(x not in ("self", "cls") for x in names), len(names), c.n, _nesting(node)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def braced_functions(text: str, language: str) -> list[tuple]:
    plain = BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out = []
    for m in HEAD.get(language, HEAD["script"]).finditer(plain):
        g = {k.rstrip("23"): v for k, v in m.groupdict().items() if v is not None}
        depth, deepest, i = 1, 1, m.end()
        while i < len(plain) and depth:
            if plain[i] == "{":
                depth += 1
                deepest = max(deepest, depth)
            elif plain[i] == "}":
                depth -= 1
            i += 1
        body = plain[m.end() : i]
        start = plain.count("\n", 0, m.start("name3") if m.groupdict().get("name3") else m.start()) + 1
        end = plain.count("\n", 0, i) + 1
        params = [p for p in re.sub(r"<[^>]*>|\{[^}]*\}", "", g.get("args", "")).split(",") if p.strip()]
        out.append((g.get("name") or "", start, end, end - start + 1, sum(p.split(":")[0].strip() != "this" for p in params), len(params), 1 + len(BRANCH.findall(body)), deepest - 1))
    return out


def functions_of(files: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, language, and the FUNCTION columns): a row per function; of files(path, content)."""
    kinds, n = dict(files.dtypes), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for r, (lang, text) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                for f in (python_functions(text) or []) if lang == "python" else braced_functions(text, lang):
                    rows.append(r)
                    found.append(f)
            at = pa.array(rows, pa.int64())
            cols = [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.int32()) for i in range(1, 8))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n + 1)), *cols], names=[*keep, "language", *[x.split()[0] for x in FUNCTION.split(", ")]])

    lang = language_of(F.col("path"))
    part = files.where((lang != "unknown") & (F.length("content") > 0)).select(*keep, lang.alias("language"), "content")
    return part.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", language string, " + FUNCTION)


def length_limit(language: Column) -> Column:
    return lookup(language, MOST_LINES, 50)


def length_findings(functions: DataFrame) -> DataFrame:
    """Functions longer than their language allows."""
    return functions.where(F.col("n_lines") > length_limit(F.col("language"))).withColumns({"category": F.lit("function_length"), "severity": F.lit("medium")})


def complexity_findings(functions: DataFrame) -> DataFrame:
    c = F.col("complexity")
    return functions.where(c > 5).withColumns({"category": F.lit("cyclomatic_complexity"), "severity": F.when(c > 20, "critical").when(c > 10, "high").otherwise("medium")})


def smell_findings(functions: DataFrame, named: bool = False) -> DataFrame:
    """Many parameters (all named ones, or without self), very long functions, deep nesting: one row each."""
    p = F.col("n_named" if named else "n_params")
    smells = F.array(
        F.when(p > 5, F.struct(F.lit("too_many_params").alias("category"), F.when(p > 8, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("n_lines") > 100, F.struct(F.lit("long_function").alias("category"), F.lit("high").alias("severity"))),
        F.when(F.col("nesting") > 4, F.struct(F.lit("deep_nesting").alias("category"), F.lit("medium").alias("severity"))),
    )
    return functions.withColumn("_s", F.explode(F.array_compact(smells))).select(*functions.columns, "_s.category", "_s.severity")


def file_stats(files: DataFrame, functions: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, n_lines, n_functions, n_classes, n_long, deepest) of each file."""
    g = functions.groupBy(*keep).agg(F.count("*").alias("n_functions"), F.count_if(F.col("n_lines") > 100).alias("n_long"), F.max("nesting").alias("deepest"))
    classes = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:export |public |abstract |final |private )*(?:class|interface|struct) (\w+)"), F.lit(1)))
    x = files.where(F.length("content") > 0).select(*keep, F.size(F.split("content", "\n")).alias("n_lines"), classes.alias("n_classes"))
    return x.join(g, keep, "left").fillna(0, ["n_functions", "n_long", "deepest"])
