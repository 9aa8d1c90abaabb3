"""Byte-pair encoding of a corpus with a public tokenizer's rank file.

Each word of the split pattern is merged on a contiguous array: the part boundaries and, beside them, the rank of each pair of
neighbouring parts. The minimum is found by scanning, its boundary deleted and the two neighbouring ranks refreshed. A word
longer than ``LONG`` bytes would make the scan quadratic; it takes a heap over linked boundaries, with the same order of merges.

Defined results: a null text has null ids, an empty text an empty list. Text that looks like a special token is plain text.
Rows are kept as they come (repeated rows stay repeated); only the two named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the split pattern of the rank file byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 96
CACHE = 200_000
NONE = 1 << 60

_encoders: dict[int, Encoder] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Encodes texts; keeps the ids of up to ``CACHE`` words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Part boundaries of a short word."""
        get = self.ranks.get
        bounds = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == NONE:
                break
            i = pairs.index(low)
            del bounds[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = get(piece[bounds[i] : bounds[i + 2]], NONE)
        return bounds

    def merged_long(self, piece: bytes) -> list[int]:
        """Part boundaries of a word of any length."""
        get, n = self.ranks.get, len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n + 1))
        rank = [get(piece[i : i + 2], NONE) for i in range(n - 1)] + [NONE, NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = after[i]
            rank[i] = get(piece[i : after[j]], NONE) if j < n else NONE
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            after[i] = after[gone]
            before[after[gone]] = i
            rank[gone] = NONE
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        out = [0]
        while out[-1] < n:
            out.append(after[out[-1]])
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pattern."""
        ids = self.known.get(word)
        if ids is None:
            piece = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(piece)
            if whole is not None:
                ids = (whole,)
            else:
                bounds = self.merged(piece) if len(piece) <= LONG else self.merged_long(piece)
                ids = tuple(self.ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:]))
            if len(piece) <= LONG:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        known, slow, out = self.known.get, self.word, []
        for w in self.words(text):
            out += known(w) or slow(w)
        return out

    def count(self, text: str) -> int:
        """The number of ids of a text."""
        known, slow = self.known.get, self.word
        return sum([len(known(w) or slow(w)) for w in self.words(text)])


def shared_ranks(spark: SparkSession, path: str = TOKENIZER) -> Broadcast:
    """The bytes of a rank file (of fixed size, under 1 MB), read by the driver, for the executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(ranks: Broadcast) -> Encoder:
    """The worker's encoder of a broadcast rank file."""
    key = hash(ranks.value)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(ranks.value))
    return _encoders[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids array<int>) of every row; see the module for null and empty texts."""
    ranks = shared_ranks(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            parts = [None if t is None else np.asarray(enc.encode(t), dtype=np.int32) for t in b.column(1).to_pylist()]
            sizes = np.array([0 if p is None else len(p) for p in parts], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([p is None for p in parts] + [False]))
            flat = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(*keep, n_tokens long) of every row; null for a null text."""
    ranks = shared_ranks(docs.sparkSession, tokenizer)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            sizes = pa.array([None if t is None else enc.count(t) for t in b.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], sizes], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
