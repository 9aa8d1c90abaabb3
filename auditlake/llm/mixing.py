"""Mixing sources to target weights by proportionate-fair scheduling.

Sizes are tokens. Each source's documents, in an order by hash, form a stream; the stream may be walked ``max_repeats`` times. A
source takes the prefix of that walk that fills ``target_weight * total``. The walk is cut into blocks of ``block_tokens``; block k
of a source with weight w is released at floor(k/w) and due at ceil((k+1)/w), and of the released blocks the one due first takes the
next slot, so no source is ever a whole block ahead of or behind its share. Weights are exact fractions (the decimals as written, over
their sum). With P their least common denominator the schedule repeats after P slots, so a table of P slots places all blocks; where the
mix has fewer slots than P, the table has those of the mix. One task makes it, row by row, with memory for the sources alone.

``total`` is a parameter. Without it, it is the largest size at which every source that has any token reaches its weight, since a
short source moves the shares of all others; ``CORPUS`` makes the mix as large as the corpus. A source that can't reach its target gives
all it may and leaves its later slots empty; the report has its actual share and ``reached`` false.

Defined results: documents with a null source, a source without target, a null, empty or token-free text take no part. Rows with one
doc_id count once each as they come (doc_id is a key of the table). A target with a null or non-positive weight or no repeats gets
nothing; of several targets of one source the largest weight and repeats hold. Ties of the hash go by id. Empty tables give an empty mix
and a report with zero shares.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.bpe import TOKENIZER, count_tokens
from auditlake.session import checkpointed, spread

BLOCK_TOKENS = 1024
#: As ``total``: the tokens of all documents whose source has a target.
CORPUS = -1
#: Plans of more sources than this aren't broadcast.
BROADCAST_SOURCES = 10_000


def exact_weights(weights: dict[str, float]) -> dict[str, Fraction]:
    """Fractions that sum to one; a float counts as the decimal it is written as."""
    exact = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def period(weights: dict[str, Fraction]) -> int:
    """The number of slots after which the schedule repeats."""
    return math.lcm(*(w.denominator for w in weights.values())) if weights else 0


def pfair_slots(weights: dict[str, Fraction], n: int) -> Iterator[tuple[str, int, int]]:
    """(source, k, slot) of the first n slots: earliest deadline first among the released blocks."""
    num, den = {s: w.numerator for s, w in weights.items()}, {s: w.denominator for s, w in weights.items()}
    waiting = [(0, s, 0) for s in sorted(weights)]  # by release
    ready: list[tuple[int, str, int]] = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * den[s] // num[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, slot
        heapq.heappush(waiting, ((k + 1) * den[s] // num[s], s, k + 1))


def plan_quotas(targets: list[tuple[str, Fraction, int]], totals: dict[str, int], total: int | None) -> tuple[dict[str, int], int]:
    """Tokens wanted of each source, and the size of the mix."""
    if total == CORPUS:
        total = sum(totals.get(s, 0) for s, _, _ in targets)
    elif total is None:
        reach = [totals[s] * m / w for s, w, m in targets if totals.get(s, 0) > 0]
        total = int(min(reach)) if reach else 0
    return {s: int(w * total) for s, w, _ in targets}, total


def _goals(rows: Iterable[tuple[str, float, int, int]], total: int | None) -> tuple[dict[str, Fraction], dict[str, int], dict[str, int], dict[str, int], int]:
    """Weights, sizes, repeats, quotas and the size of the mix, of (source, weight, repeats, size) rows."""
    rows = list(rows)
    weights = exact_weights({r[0]: float(r[1]) for r in rows})
    sizes, most = {r[0]: int(r[3]) for r in rows}, {r[0]: int(r[2]) for r in rows}
    quotas, size = plan_quotas([(s, weights[s], most[s]) for s in weights], sizes, total)
    return weights, sizes, most, quotas, size


def needed_slots(weights: dict[str, Fraction], quotas: dict[str, int], total: int, block: int) -> Iterator[tuple[str, int, int]]:
    """The slots of one period, or of the whole mix where that is shorter; blocks that fall due after its end follow in the order of their deadlines."""
    p, n = period(weights), total // block + 1
    if p <= n:
        yield from pfair_slots(weights, p)
        return
    done = dict.fromkeys(weights, 0)
    for s, k, slot in pfair_slots(weights, n):
        done[s] = k + 1
        yield s, k, slot
    left = heapq.merge(*([((k + 1) / weights[s], s, k) for k in range(done[s], -(-quotas[s] // block))] for s in sorted(weights)))
    for i, (_, s, k) in enumerate(left):
        yield s, k, n + i


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple[str, float, int, int]]:
    return [r for f in frames for r in f[["source", "weight", "most", "size"]].itertuples(index=False, name=None)]


def _plan_frames(total: int | None):
    """(source, size, most, quota, unit, period) of each source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, sizes, most, quotas, _ = _goals(_rows(frames), total)
        p = period(weights)
        # A period beyond 64 bits never comes round: every block then has its own row.
        far = 1 << 62
        yield pd.DataFrame([(s, sizes[s], most[s], quotas[s], min(int(w * p), far), min(p, far)) for s, w in weights.items()], columns=["source", "size", "most", "quota", "unit", "period"])

    return run


def _slot_frames(total: int | None, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, _, _, quotas, size = _goals(_rows(frames), total)
        part: list[tuple[str, int, int]] = []
        for row in needed_slots(weights, quotas, size, block) if weights else ():
            part.append(row)
            if len(part) == 50_000:
                yield pd.DataFrame(part, columns=["source", "k", "slot_in"])
                part = []
        yield pd.DataFrame(part, columns=["source", "k", "slot_in"])

    return run


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(slot, source, doc_id, copy, n_tokens, source_offset): the mix; ascending (slot, source_offset) is its order."""
    goals = targets.where("source is not null and target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_weight").cast("double").alias("weight"), F.max("max_repeats").alias("most"))
    few = goals.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda d: d
    d = docs.select("doc_id", "source", "text").where(F.length("text") > 0).join(small(goals.select("source")), "source", "left_semi")
    # Counted once: the range partitioning reads its input twice.
    sized = checkpointed(count_tokens(spread(d), ["doc_id", "source"], tokenizer=tokenizer).where("n_tokens > 0"))
    ranged = checkpointed(sized.withColumn("h", F.xxhash64("doc_id")).repartitionByRange("source", "h", "doc_id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))  # one row per part, and source
    before = sums.select("source", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    told = checkpointed(goals.join(sums.groupBy("source").agg(F.sum("n").alias("size")), "source", "left").select("source", "weight", "most", F.coalesce("size", F.lit(0)).alias("size")))
    one = told.coalesce(1)
    plan = one.mapInPandas(_plan_frames(total), "source string, size long, most long, quota long, unit long, period long")
    slots = one.mapInPandas(_slot_frames(total, block_tokens), "source string, k long, slot_in long")
    w = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.join(before, ["source", "part"])
        .withColumn("first", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        .join(small(plan), "source")
        .where("first < quota")
        .withColumn("copy", F.explode(F.expr("sequence(0, least(most - 1, (quota - 1 - first) div size))")))
        .withColumn("source_offset", F.col("first") + F.col("copy") * F.col("size"))
        .withColumn("block", F.expr(f"source_offset div {int(block_tokens)}"))
        .withColumn("k", F.expr("block % unit"))
    )
    return placed.join(slots, ["source", "k"]).select(F.expr("(block div unit) * period + slot_in").alias("slot"), "source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens", "source_offset")


def shares(mixed: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(source, target_weight, max_repeats, n_docs, most_copies, n_tokens, actual_share, reached) of each target.

    ``reached``: the actual share is at least the target less ``tolerance``.
    """
    got = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("n"))
    got = got.groupBy("source").agg(F.count("*").alias("docs"), F.max("c").alias("c"), F.sum("n").alias("n"))
    goal = targets.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = goal.join(got, "source", "left").withColumn("all_n", F.sum("n").over(Window.partitionBy()))
    share = F.coalesce(F.round(F.col("n") / F.col("all_n"), 6), F.lit(0.0))
    return out.select(
        "source", "target_weight", "max_repeats", zero("docs").alias("n_docs"), zero("c").alias("most_copies"), zero("n").alias("n_tokens"),
        share.alias("actual_share"), (share >= F.col("target_weight") - tolerance).alias("reached"),
    )
