"""Import graphs: edges, degrees, isolated modules, bounded cycles, strongly connected components."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import checkpointed

# Top-level names of standard and third-party libraries, by language.
EXTERNAL = {
    "python": [
        "os", "sys", "re", "json", "math", "datetime", "collections", "itertools", "functools", "typing", "abc", "pathlib", "io", "subprocess", "logging", "hashlib", "base64", "uuid", "copy",
        "enum", "dataclasses", "asyncio", "threading", "multiprocessing", "http", "urllib", "socket", "ssl", "email", "csv", "xml", "argparse", "configparser", "unittest", "traceback", "warnings",
        "contextlib", "inspect", "ast", "textwrap", "shutil", "tempfile", "pickle", "marshal", "struct", "sqlite3", "random", "statistics", "time", "platform", "signal", "atexit", "gc", "types",
        "fastapi", "uvicorn", "sqlalchemy", "alembic", "pydantic", "langgraph", "langchain", "litellm", "starlette", "networkx", "tree_sitter", "semgrep", "radon", "redis", "celery",
        "httpx", "tiktoken", "opentelemetry", "prometheus_client", "websockets", "git", "numpy", "pandas", "requests", "aiohttp", "transformers", "torch", "tensorflow",
    ],
    "go": [
        "fmt", "os", "io", "net", "http", "strings", "strconv", "errors", "context", "sync", "time", "math", "sort", "path", "filepath", "encoding", "crypto", "log", "runtime", "reflect", "unsafe",
        "database", "testing", "flag", "bytes", "bufio", "regexp", "github", "golang.org", "gopkg.in", "google.golang.org",
    ],
    "typescript": ["react", "vue", "axios", "lodash", "express", "next", "nuxt", "typescript", "rxjs", "moment", "uuid", "zod", "yup", "fs", "path", "http", "https", "crypto", "os", "url", "util", "child_process", "stream", "events", "buffer", "querystring"],
    "javascript": ["react", "vue", "axios", "lodash", "express", "next", "nuxt", "moment", "uuid", "zod", "yup", "chalk", "commander", "fs", "path", "http", "https", "crypto", "os", "url", "util", "child_process", "stream", "events", "buffer", "querystring"],
    "java": ["java", "javax", "org", "com", "sun", "jdk", "spring", "hibernate", "apache", "junit", "mockito", "lombok", "slf4j", "log4j", "jackson", "gson", "guava", "reactor"],
}


def resolved(imported: Column, language: Column) -> Column:
    """The dotted module that an import of the language names; null for standard and third-party libraries."""
    slashed = language.isin("go", "typescript", "javascript")
    top = F.when(slashed, F.substring_index(imported, "/", 1)).otherwise(F.substring_index(imported, ".", 1))
    outside = F.lit(False)
    for name, known in EXTERNAL.items():
        outside = outside | ((language == name) & top.isin(known))
    script = language.isin("typescript", "javascript")
    relative = script & imported.startswith(".")
    # A Java import of one segment is never taken for a library's.
    outside = outside & ~relative & ~((language == "java") & ~imported.contains("."))
    dotted = F.when(relative, F.btrim(F.translate(imported, "/", "."), F.lit("."))).when(language == "go", F.translate(imported, "/", ".")).otherwise(imported)
    return F.when(~outside, dotted)


def import_edges(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(review_id, src, dst, kind), distinct: of modules(review_id, file_seq, module) and imports(review_id, file_seq, language, imported).

    An import goes to the module of its name, else to the first module whose last segment is the import's, else to a new external node.
    """
    own = imports.withColumn("imported", resolved(F.col("imported"), F.col("language"))).where("imported is not null").drop("language").withColumn("simple", F.substring_index("imported", ".", -1))
    src = modules.select("review_id", "file_seq", F.col("module").alias("src"))
    exact = modules.select("review_id", F.col("module").alias("imported")).distinct().withColumn("_m", F.col("imported"))
    first = modules.groupBy("review_id", F.substring_index("module", ".", -1).alias("simple")).agg(F.min_by("module", "file_seq").alias("_f"))
    x = own.join(src, ["review_id", "file_seq"]).join(exact, ["review_id", "imported"], "left").join(first, ["review_id", "simple"], "left")
    x = x.where(F.col("imported") != F.col("src"))
    kind = F.when(F.col("_m").isNotNull(), "exact").when(F.col("_f").isNotNull(), "simple").otherwise("external")
    return x.select("review_id", "src", F.coalesce("_m", "_f", "imported").alias("dst"), kind.alias("kind")).distinct()


def coupled(edges: DataFrame, most: int = 5) -> DataFrame:
    """(review_id, module, in_degree, severity) of modules with more than ``most`` distinct importers."""
    d = edges.groupBy("review_id", F.col("dst").alias("module")).agg(F.count_distinct("src").alias("in_degree")).where(F.col("in_degree") > most)
    return d.withColumn("severity", F.when(F.col("in_degree") > 10, "critical").when(F.col("in_degree") > 8, "high").otherwise("medium"))


def isolated(modules: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(review_id, module) without any edge, in reviews of two files or more with at most ``most`` such modules."""
    touched = edges.select("review_id", F.col("src").alias("module")).unionByName(edges.select("review_id", F.col("dst").alias("module"))).distinct()
    alone = modules.select("review_id", "module").distinct().join(touched, ["review_id", "module"], "left_anti")
    several = modules.groupBy("review_id").agg(F.count("*").alias("n")).where("n >= 2").select("review_id")
    few = alone.groupBy("review_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("review_id")
    return alone.join(several, "review_id", "left_semi").join(few, "review_id", "left_semi")


def _strong(edges: list[tuple[str, str]]) -> list[list[str]]:
    """The sorted components of two nodes or more, by a search forwards and one backwards."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for root in list(out):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            v, rest = stack[-1]
            w = next((x for x in rest if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(out.get(w, ()))))
    found, done = [], set()
    for v in reversed(order):
        if v in done:
            continue
        done.add(v)
        part, todo = [], [v]
        while todo:
            part.append(todo.pop())
            more = {w for w in back.get(part[-1], ()) if w not in done}
            done |= more
            todo += more
        if len(part) > 1:
            found.append(sorted(part))
    return found


def components(edges: DataFrame, key: str) -> DataFrame:
    """(key, members array): the strongly connected components of two nodes or more of each key's graph; a graph is held by one task."""

    def run(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = _strong(list(zip(part.src, part.dst)))
        return pd.DataFrame({key: [name[0]] * len(found), "members": found}, dtype=object)

    kind = dict(edges.dtypes)[key]
    e = edges.where("src <> dst").select(key, "src", "dst").distinct()
    return e.groupBy(key).applyInPandas(run, f"`{key}` {kind}, members array<string>")


def cycles(edges: DataFrame, longest: int = 6, key: str | None = None) -> DataFrame:
    """(key, cycle array): simple cycles of two to ``longest`` nodes of edges(key, src, dst), from their smallest node on; without a key one graph.

    Paths only grow over nodes larger than their first, so every cycle is found once; each step is one join, and paths are bounded by
    ``longest``. What is longer lies within components().
    """
    k = [key] if key else []
    e = edges.select(*k, "src", "dst").where("src <> dst").distinct()
    paths = e.where("dst > src").select(*k, F.array("src", "dst").alias("path"))
    found = None
    for n in range(2, longest + 1):
        last = paths.select(*k, "path", F.element_at("path", -1).alias("src"))
        step = last.join(e, [*k, "src"])
        closed = step.where(F.col("dst") == F.element_at("path", 1)).select(*k, F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            paths = step.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(*k, F.concat("path", F.array("dst")).alias("path"))
    return found


def cycle_report(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(review_id, kind, modules array): every cycle of up to ``longest`` modules, and each component of more, which may hold longer ones, whole."""
    c = checkpointed(components(edges, "review_id").withColumn("c", F.monotonically_increasing_id()))
    at = c.select("review_id", "c", F.explode("members").alias("m"))
    inside = edges.join(at.select("review_id", F.col("m").alias("src"), F.col("c").alias("_a")), ["review_id", "src"]).join(at.select("review_id", F.col("m").alias("dst"), F.col("c").alias("_b")), ["review_id", "dst"])
    inside = checkpointed(inside.where("_a = _b").select("review_id", "src", "dst").distinct())
    whole = c.where(F.size("members") > longest).select("review_id", F.lit("component").alias("kind"), F.col("members").alias("modules"))
    return cycles(inside, longest, "review_id").select("review_id", F.lit("cycle").alias("kind"), F.col("cycle").alias("modules")).unionByName(whole)
