"""Source files that aren't valid syntax for the language of their extension.

Each language has a packrat parsing-expression grammar over its tokens; a file is valid if the grammar consumes all of it. The memo is
keyed by content: a block, a logical line or a top-level item is parsed once, wherever it recurs, in this file or the next (``syntax``).
A file that fails is read again with offsets, for the line of the furthest failure and its cause: ``conflict`` (merge markers),
``patch`` (a diff), ``response`` (an error page instead of the file), ``truncated`` (the input ended too early), ``language`` (it is
valid in another of the languages), else ``syntax``. Nesting is followed however deep.

Defined results: null and empty contents, null paths and other extensions are no cases; the extension counts in any case; redelivered
rows are one record. Files of a null or unknown repository are reported under a null one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.syntax import golang, java, javascript, python
from auditlake.llm.syntax.lex import BAD, Braced, furthest, merged, replaced
from auditlake.session import spread

#: Calls of Python functions nest on the heap, so the depth is bounded by memory alone.
DEPTH = 1 << 30
STRUCTURE_END = re.compile("<+$")
LANGUAGES: dict[str, tuple[str, Callable[[str], bool]]] = {
    "py": ("python", python.valid),
    "go": ("go", golang.valid),
    "java": ("java", java.valid),
    "js": ("javascript", lambda t: javascript.valid(t, False, False)),
    "jsx": ("javascript", lambda t: javascript.valid(t, False, True)),
    "ts": ("typescript", lambda t: javascript.valid(t, True, False)),
    "tsx": ("typescript", lambda t: javascript.valid(t, True, True)),
}
EXTENSION = r"(?i)\.(py|go|java|js|jsx|ts|tsx)$"
MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |$)")


def valid(text: str, extension: str) -> bool:
    """The text is valid for the extension (without dot, in lower case)."""
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    return LANGUAGES[extension][1](text)


def _offsets_javascript(text: str) -> tuple[list[str], list[int]]:
    chars, at, last = [], [], 0
    for m in javascript.LEX.finditer(text):
        if m.start() < last:
            continue
        chars += text[last : m.start()]
        at += range(last, m.start())
        last = m.end()
        k = m.lastindex
        if k == 6:
            found = javascript.template_end(text, m.start())
            if found is None:
                return [*chars, BAD], [*at, m.start()]
            piece = "`" + "".join("{" + javascript.tokens(text[a:b]) + "}" for a, b in found[1]) + "`"
            chars += piece
            at += [m.start()] * len(piece)
            last = found[0]
            continue
        c = {1: " ", 2: "\n" if "\n" in m.group() else " ", 3: "S", 5: "n", 7: "S", 8: " "}.get(k, BAD) if k != 4 else javascript.TABLE.words.get(m.group(), "i")
        chars.append(c)
        at.append(m.start())
    return chars + list(text[last:]), at + list(range(last, len(text)))


def _offsets(text: str, lex: re.Pattern, one: Callable[[re.Match], str]) -> tuple[list[str], list[int]]:
    chars, at, last = [], [], 0
    for m in lex.finditer(text):
        chars += text[last : m.start()]
        at += range(last, m.start())
        chars.append(one(m))
        at.append(m.start())
        last = m.end()
    return chars + list(text[last:]), at + list(range(last, len(text)))


def _braced_failure(text: str, extension: str) -> int:
    """The offset of the furthest failure, for the languages with braces."""
    lang: Braced
    if extension == "go":
        kind = {1: " ", 3: "S", 5: "n", 6: " ", 7: BAD}
        chars, at = _offsets(text + "\n", golang.LEX, lambda m: golang.TABLE.words.get(m.group(), "i") if m.lastindex == 4 else ("\n" if "\n" in m.group() else " ") if m.lastindex == 2 else kind[m.lastindex])
        s, at = merged(golang.TABLE, chars, at)
        s, at = replaced(golang.SEMICOLON, ";", s, at)
        s, at = replaced(re.compile("\n"), "", s, at)
        lang, top = golang.language(), "file"
    elif extension == "java":
        kind = {1: " ", 2: "S", 4: "n", 5: " ", 6: BAD}
        chars, at = _offsets(text, java.LEX, lambda m: java.TABLE.words.get(m.group(), "i") if m.lastindex == 3 else kind[m.lastindex])
        s, at = merged(java.TABLE, chars, at)
        lang, top = java.language(), "file"
    else:
        chars, at = _offsets_javascript(text)
        s, at = merged(javascript.TABLE, chars, at)
        s, at = replaced(javascript.JOIN, "", s, at)
        lang, top = javascript.language(extension in ("ts", "tsx"), extension in ("jsx", "tsx")), "stmts"
    return furthest(lang, s, at, top) if s else 0


def _python_failure(text: str) -> int:
    """The line of the failure: the first line that doesn't parse, or at which the structure breaks."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    lo, hi = 1, text.count("\n") + 1
    source = text.split("\n")
    # The first line whose prefix holds a broken string or logical line.
    flat = python.tokens(text)
    if BAD in flat or '"' in flat or "'" in flat:
        spots = [i for i in (flat.find(BAD), flat.find('"'), flat.find("'")) if i >= 0]
        while lo < hi:  # tokens of a prefix are a prefix of the tokens, up to the break
            mid = (lo + hi) // 2
            piece = python.tokens("\n".join(source[:mid]) + "\n")
            if BAD in piece or '"' in piece or "'" in piece:
                hi = mid
            else:
                lo = mid + 1
        return min(lo, flat.count("\n", 0, min(spots)) + 1) if spots else lo
    lines = python.logical_lines(flat)
    if lines is None:
        return len(source)
    kinds, bad = python.structure(lines)
    if bad < 0:
        # The characters of lines, up to the furthest failure; indents, dedents and bodies on the line are none.
        upto = STRUCTURE_END.sub("", kinds)
        at = min(python.STRUCTURE.trace("file", kinds), len(upto) - 1)
        bad = max(0, sum(c not in "<>b" for c in kinds[: at + 1]) - 1)
    seen = -1
    depth = 0
    for n, line in enumerate(flat.split("\n"), 1):
        if not depth and not line.strip():
            continue
        if not depth:
            seen += 1
            if seen == bad:
                return n
        depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
    return len(source)


def failure(text: str, extension: str) -> tuple[int, str]:
    """(line, cause) of an invalid text."""
    lines = text.split("\n")
    try:
        if extension == "py":
            line = _python_failure(text)
        else:
            line = text.count("\n", 0, _braced_failure(text, extension)) + 1
    except RecursionError:
        return 1, "depth"
    line = max(1, min(line, len(lines)))
    near = [lines[i].rstrip("\r") for i in range(max(0, line - 2), min(len(lines), line + 1))]
    first = next((x.strip() for x in lines if x.strip()), "")
    if any(MARKER.match(x) for x in near) or sum(bool(MARKER.match(x.rstrip("\r"))) for x in lines) >= 2:
        cause = "conflict"
    elif re.match(r"@@ -\d|diff --git |--- a/|Index: ", first):
        cause = "patch"
    elif re.match(r"(?i)<!doctype html|<html|\d{3}:? [A-Z]|<\?xml|\{\"(?:message|error)\"", first):
        cause = "response"
    elif any(_ok(f, text) for e, (name, f) in LANGUAGES.items() if name != LANGUAGES[extension][0] and e != "jsx"):
        cause = "language"
    elif line >= len(text.rstrip().split("\n")):
        cause = "truncated"
    else:
        cause = "syntax"
    return line, cause


def _ok(f: Callable[[str], bool], text: str) -> bool:
    try:
        return f(text)
    except RecursionError:
        return False


def check_files(files: DataFrame) -> DataFrame:
    """(review_id, file_seq, language, valid, line, cause) of every file that is judged; line and cause of the invalid ones."""
    part = files.where(F.col("path").rlike(EXTENSION) & (F.length("content") > 0)).select("review_id", "file_seq", F.lower(F.regexp_extract("path", EXTENSION, 1)).alias("ext"), "content")
    seq = dict(files.dtypes)["file_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, oks, at, causes = [], [], [], []
            for ext, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                try:
                    ok, line, cause = valid(text, ext), None, None
                except RecursionError:
                    ok, line, cause = False, 1, "depth"
                if not ok and cause is None:
                    line, cause = failure(text, ext)
                names.append(LANGUAGES[ext][0])
                oks.append(ok)
                at.append(line)
                causes.append(cause)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(oks, pa.bool_()), pa.array(at, pa.int32()), pa.array(causes, pa.string())], names=["review_id", "file_seq", "language", "valid", "line", "cause"])

    return spread(part).mapInArrow(run, f"review_id string, file_seq {seq}, language string, valid boolean, line int, cause string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(review_id, file_seq, language, line, cause) of the invalid files."""
    return check_files(files).where("not valid").drop("valid").distinct()


def rates(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate, n_<cause>...) by repository (of ``repos``: review_id, repo) and language."""
    judged = check_files(files).dropDuplicates(["review_id", "file_seq"]).join(repos, "review_id", "left")
    bad = F.sum(F.when(~F.col("valid"), 1).otherwise(0))
    causes = [F.sum(F.when(F.col("cause") == c, 1).otherwise(0)).alias(f"n_{c}") for c in ("conflict", "patch", "response", "truncated", "language", "syntax", "depth")]
    return judged.groupBy("repo", "language").agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), F.round(bad / F.count("*"), 6).alias("rate"), *causes)
