import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import bpe, mixing as M


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefg", min_size=1, max_size=2), st.one_of(st.floats(0.001, 1), st.sampled_from([0.1, 0.2, 0.25, 1 / 3, 0.3])), min_size=1, max_size=8))
def test_less_than_one_block_off(weights):
    exact = M.exact_weights(weights)
    assert sum(exact.values()) == 1
    had = dict.fromkeys(exact, 0)
    for s, k, slot in M.pfair_slots(exact, 400):
        assert k == had[s]
        had[s] += 1
        for x, w in exact.items():
            assert abs(had[x] - w * (slot + 1)) < 1


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.05, "b": 0.15, "c": 0.35, "d": 0.45}])
def test_the_period_repeats_without_drift(weights):
    exact = M.exact_weights(weights)
    p = M.period(exact)
    table = list(M.pfair_slots(exact, p))
    units = {s: int(w * p) for s, w in exact.items()}
    had = dict.fromkeys(exact, 0)
    for turn in range(50):
        for s, k, slot in table:
            assert turn * units[s] + k == had[s]
            had[s] += 1
            assert all(abs(had[x] - w * (turn * p + slot + 1)) < 1 for x, w in exact.items())


def test_blocks_due_after_the_end_follow():
    exact = M.exact_weights({"a": 0.999999937, "b": 0.000000063})
    rows = list(M.needed_slots(exact, {"a": 9999, "b": 5}, 10000, 100))
    assert {(s, k) for s, k, _ in rows} >= {("a", k) for k in range(100)} | {("b", 0)} and len({slot for _, _, slot in rows}) == len(rows)


@pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no rank file")
def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), "big", 1) for i in range(300)] + [(1000 + i, "term " * 9, "small", 1) for i in range(20)] + [(5000, None, "big", 1), (5001, "", "small", 1), (5002, "text", None, 1), (5003, "text", "other", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    got = M.mix(df, targets, block_tokens=64).collect()
    per = {}
    for r in got:
        assert r.source in ("big", "small")
        per.setdefault(r.source, []).append(r)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens for r in per["big"]) / total - 0.7) < 0.02
    for s, most in (("big", 1), ("small", 3)):
        assert max(sum(x.doc_id == r.doc_id for x in per[s]) for r in per[s]) <= most
        offs = sorted((r.source_offset, r.n_tokens) for r in per[s])
        assert all(a + n == b for (a, n), (b, _) in zip(offs, offs[1:]))  # no gap and no overlap
    # In schedule order the shares hold all along, but for a block and a document.
    run = {"big": 0, "small": 0}
    for r in sorted(got, key=lambda r: (r.slot, r.source_offset)):
        run[r.source] += r.n_tokens
        assert abs(run["big"] - 0.7 * sum(run.values())) < 64 + 40
    share = {r.source: r for r in M.shares(M.mix(df, targets), targets.where("source is not null")).collect()}
    assert share["big"].reached and share["small"].reached and share["absent"].n_docs == 0


@pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no rank file")
def test_target_out_of_reach(spark):
    df = spark.createDataFrame([(i, "word " * 10, "a") for i in range(100)] + [(200, "word " * 10, "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_weight double, max_repeats int")
    share = {r.source: r for r in M.shares(M.mix(df, targets, total=800), targets).collect()}
    assert share["a"].reached and not share["b"].reached and share["b"].most_copies == 2
    share = {r.source: r for r in M.shares(M.mix(df, targets, total=M.CORPUS), targets).collect()}
    assert share["a"].actual_share > 0.9 and not share["b"].reached
    empty = M.mix(df.limit(0), targets)
    assert empty.count() == 0 and {r.n_tokens for r in M.shares(empty, targets).collect()} == {0}
