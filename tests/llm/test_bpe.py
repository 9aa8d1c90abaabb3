import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.TOKENIZER), reason="no rank file")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.TOKENIZER, "rb"))}
    return B.Encoder(ranks), tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_against_library(both, text):
    own, lib = both
    assert own.encode(text) == lib.encode_ordinary(text)
    assert own.count(text) == len(own.encode(text))


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a" * 5000, "é" * 3000, "!?" * 2000, "it's we'll  x\r\n\ty", "汉字かな" * 100])
def test_cases(both, text):
    own, lib = both
    assert own.encode(text) == lib.encode_ordinary(text)


def test_long_and_short_merge_alike(both):
    own, _ = both
    for w in ("internationalization", "supercalifragilistic", "ab" * 40, "xyzzy"):
        assert own.merged(w.encode()) == own.merged_long(w.encode())


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", None), (3, "hello world", None)], "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in B.encode_corpus(df).collect()}
    assert got == {(1, None), (2, ()), (3, (31373, 995))}
    assert B.encode_corpus(df.limit(0)).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in B.count_tokens(df, ["doc_id"]).collect()} == {(1, None), (2, 0), (3, 2)}
