"""Cutting oversized texts at natural boundaries, with an overlap.

A text is read as tokens (a word, a run of blanks, a line end, or one other character); their prefix sums are the offsets at which a
cut is possible. The sorted offsets of each kind of boundary form an array, best kind first: before a definition at the left margin,
after a blank line, after a line end, after ``;`` ``{`` ``}`` or ``,``, after blanks, between tokens. A piece ends at the last boundary
under the limit of the best kind that leaves it at least half full, found by binary search; the next piece steps back by up to
``overlap`` characters, to the first line start (or token) within them. A token longer than a piece is cut hard. CR LF stays whole.

Sizes are Unicode code points. Defined results: a null or empty text, or one within the limit, is one piece (null text: no piece);
joining the pieces without their overlaps gives the text back exactly. Rows with one key are one record (the latest ``fetched_at``
where it exists). Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 8000
OVERLAP = 400
TOKEN = re.compile(r"\r\n|\n|\w+|[^\S\r\n]+|.", re.S)
#: What begins a definition at the left margin, after a line end: not a blank, a closing bracket or a continuation word.
DEFINITION = re.compile(r"(?<=\n)(?=[A-Za-z_@#/\"'])(?!(?:else|elif|except|finally|catch)\b)")
BLANK_LINE = re.compile(r"\n[^\S\n]*\r?\n(?=[^\r\n])")


def boundaries(text: str, offsets: list[int]) -> list[list[int]]:
    """Sorted offsets of each kind of boundary, best kind first."""
    blank = [m.end() for m in BLANK_LINE.finditer(text)]
    after_blank = set(blank)
    lines = [m.end() for m in re.finditer("\n", text)]
    return [
        [m.start() for m in DEFINITION.finditer(text) if m.start() in after_blank],
        blank,
        lines,
        [m.end() for m in re.finditer(r"[;{},]", text)],
        [m.end() for m in re.finditer(r"\s+", text)],
        offsets,
    ]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, fresh, end) of the pieces: text[begin:end], of which text[begin:fresh] repeats the piece before."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    offsets = list(accumulate(len(t) for t in TOKEN.findall(text)))
    kinds = boundaries(text, offsets)
    lines = kinds[2]
    pieces, begin, fresh = [], 0, 0
    while True:
        most = begin + limit
        if most >= n:
            pieces.append((begin, fresh, n))
            return pieces
        least = max(fresh + 1, begin + limit // 2)
        end = 0
        for at in kinds[:5]:
            i = bisect_right(at, most) - 1
            if i >= 0 and at[i] >= least:
                end = at[i]
                break
        if not end:  # no boundary in the upper half
            for at in kinds[2:]:
                i = bisect_right(at, most) - 1
                if i >= 0 and at[i] > fresh and at[i] > begin + overlap:
                    end = at[i]
                    break
        if not end:
            end = most - (text[most - 1 : most + 1] == "\r\n")
        pieces.append((begin, fresh, end))
        back = max(end - overlap, begin + 1)
        i = bisect_left(lines, back)
        if i < len(lines) and lines[i] < end:
            begin = lines[i]
        else:
            i = bisect_left(offsets, back)
            begin = offsets[i] if i < len(offsets) and offsets[i] < end else back
        fresh = end


def split_oversized(df: DataFrame, key: list[str], text_col: str = "content", path_col: str | None = "path", order_col: str | None = "fetched_at", limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = True) -> DataFrame:
    """(*key, path, piece_no, n_pieces, begin, fresh, end, text) of the pieces of each text.

    Only texts over the limit are read by Python; the shorter ones, if wanted, are one piece each by an expression.
    """
    kinds = dict(df.dtypes)
    path = [path_col] if path_col else []
    cols = [*key, *path]

    def latest(d: DataFrame) -> DataFrame:
        if order_col is None or order_col not in d.columns:
            return d.dropDuplicates(key)
        rest = F.max_by(F.struct(*path, text_col), F.struct(F.col(order_col).isNotNull(), order_col)).alias("_r")
        return d.groupBy(*key).agg(rest).select(*key, *[f"_r.{c}" for c in [*path, text_col]])

    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, piece, texts = [], [], []
            for r, text in enumerate(b.column(k).to_pylist()):
                cuts = cut(text, limit, overlap)
                for j, (begin, fresh, end) in enumerate(cuts):
                    rows.append(r)
                    piece.append((j, len(cuts), begin, fresh, end))
                    texts.append(text[begin:end])
            at = pa.array(rows, pa.int64())
            ints = [pa.array([p[i] for p in piece], pa.int32()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(k)], *ints, pa.array(texts, pa.string())], names=[*cols, "piece_no", "n_pieces", "begin", "fresh", "end", "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", piece_no int, n_pieces int, begin int, fresh int, end int, text string"
    size = F.length(text_col)
    big = latest(df.select(*cols, text_col, *([order_col] if order_col in df.columns else [])).where(size > limit)).mapInArrow(run, schema)
    if only_oversized:
        return big
    small = latest(df.select(*cols, text_col, *([order_col] if order_col in df.columns else [])).where(size <= limit))
    zero = F.lit(0)
    return big.unionByName(small.select(*cols, zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("begin"), zero.alias("fresh"), size.alias("end"), F.col(text_col).alias("text")))
