"""Scalar expressions on findings, files, paths and texts; all stay within the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity order, the language of each suffix, deductions in twentieths of a point, escapes.
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
LANGUAGES = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java"}
DEDUCTIONS = {"critical": 20, "high": 10, "medium": 3, "low": 1}
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
#: Line ends of a text, as a regular expression of Java.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lookup(key: Column, values: dict, default) -> Column:
    """values[key], else the default; the key is evaluated once."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def severity_weight(severity: Column) -> Column:
    """5 for critical to 1 for info, in any case; 0 for what is unknown or null."""
    return lookup(F.lower(severity), SEVERITIES, 0)


def in_domain(severity: Column) -> Column:
    return F.coalesce(severity.isin(*SEVERITIES), F.lit(False))


def language_of(path: Column) -> Column:
    """By suffix, in any case; unknown for others and null."""
    return lookup(F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)), LANGUAGES, "unknown")


def lines_of(text: Column) -> Column:
    """The lines of a text; no trailing empty line, none of an empty or null text."""
    parts = F.split(text, LINE_END, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(whole)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty or null text."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def html_escape(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ESCAPES.items(), text)


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def masked_key(key: Column) -> Column:
    """A label if unset, dots if short, else the ends."""
    return F.when(key.isNull() | (key == "") | key.startswith("your-"), F.lit("(unset)")).when(F.length(key) <= 8, F.lit("........")).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(2))))


def score_tenths(c: Column, h: Column, m: Column, low: Column) -> Column:
    """Ten less half of the deductions, within 0 and 10, in tenths, halves rounded up; whole numbers throughout."""
    d = DEDUCTIONS
    twentieths = F.least(F.lit(200), F.greatest(F.lit(0), F.lit(200) - c * d["critical"] - h * d["high"] - m * d["medium"] - low * d["low"]))
    return F.floor((twentieths + 1) / 2).cast("long")


def duration_text(ms: Column) -> Column:
    """Milliseconds under a second, else seconds with one decimal."""
    tenths = F.expr("1") * F.floor((ms + 50) / 100).cast("long")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))


def module_of(path: Column, language: Column) -> Column:
    """The dotted module name of a file; a package's __init__ names the package."""
    suffix = lookup(language, {"python": ".py", "go": ".go", "typescript": ".ts", "javascript": ".js", "java": ".java"}, ".py")
    bare = F.when(path.endswith(suffix), F.left(path, F.length(path) - F.length(suffix))).otherwise(path)
    package = F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", "")).otherwise(bare)
    chosen = F.when((language == "python") & bare.endswith("__init__"), package).otherwise(bare)
    return F.btrim(F.translate(chosen, "/\\", ".."), F.lit("."))


def repo_parts(url: Column) -> list[Column]:
    """host, owner, repo, branch, kind of a repository URL in its spellings; null parts where it isn't one."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"\.git$", ""), r"/+$", "")
    got = lambda i: F.nullif(F.regexp_extract(u, r"^https?://([^/]+)/([^/]+)/([^/]+)(?:/(blob|tree)/([^/]+))?(?:/.*)?$", i), F.lit(""))
    kind = F.when(got(4) == "blob", "file").when(got(4) == "tree", "dir").when(got(3).isNotNull(), "repo")
    return [F.lower(got(1)).alias("host"), got(2).alias("owner"), F.regexp_replace(got(3), r"\.git$", "").alias("repo"), got(5).alias("branch"), kind.alias("kind")]
