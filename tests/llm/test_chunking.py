import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from auditlake.llm import chunking as C


def check(text, limit, overlap):
    pieces = C.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    for i, (b, f, e) in enumerate(pieces):
        assert e - b <= limit and b <= f <= e and f - b <= overlap
        if i:
            assert f == pieces[i - 1][2] and b > pieces[i - 1][0]
        if i + 1 < len(pieces):
            assert text[e - 1 : e + 1] != "\r\n"
    assert "".join(text[f:e] for _, f, e in pieces) == text
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r;{}é👍", min_size=0, max_size=900), st.integers(20, 120))
def test_round_trip(text, limit):
    check(text, limit, limit // 3)


def test_cuts_at_line_ends():
    text = "".join(f"line {i} of the file\n" for i in range(2000))
    for b, _, e in check(text, 8000, 400)[:-1]:
        assert text[e - 1] == "\n" and (b == 0 or text[b - 1] == "\n")


def test_prefers_definitions():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 40 + "\n\n" for i in range(60))
    for _, _, e in check(text, 8000, 400)[:-1]:
        assert text.startswith("def ", e)


def test_hard_cut_of_one_token():
    pieces = check("x" * 30_000, 8000, 400)
    assert len(pieces) == 4 and pieces[1][1] - pieces[1][0] == 400


def test_overlap_is_bounded():
    with pytest.raises(ValueError):
        C.cut("a" * 100, 20, 15)


def test_frame(spark):
    schema = T.StructType.fromDDL("review_id string, file_seq int, path string, content string, fetched_at timestamp_ntz, piece_no string")
    long = "word " * 4000
    rows = [("a", 1, "p", long, None, "clash"), ("a", 1, "p", long, None, "again"), ("b", 1, None, None, None, None), ("c", 1, "p", "", None, None), ("d", None, None, "x" * 8000, None, None), ("e", None, None, "x" * 8001, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = C.split_oversized(df, ["review_id", "file_seq"]).collect()
    assert {r.review_id for r in got} == {"a", "e"}
    a = sorted((r for r in got if r.review_id == "a"), key=lambda r: r.piece_no)
    assert "".join(r.text[r.fresh - r.begin :] for r in a) == long and len({r.piece_no for r in a}) == len(a)
    every = C.split_oversized(df, ["review_id", "file_seq"], only_oversized=False)
    assert {r.review_id for r in every.collect()} == {"a", "c", "d", "e"}
    assert C.split_oversized(df.limit(0), ["review_id", "file_seq"]).count() == 0


def test_statements_of_long_lines_end_pieces():
    text = "".join("x" * 699 + "\n" + "ab = 1; " * 980 + "\n" for _ in range(4))
    pieces = C.cut(text, 8000, 400)
    assert len(pieces) == 5 and all(text[e - 1] in "\n; " for _, _, e in pieces)
