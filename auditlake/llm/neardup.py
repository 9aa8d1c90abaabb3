"""Near-duplicate reports: universal hash minima, banding, verification, components.

A report's set is the words of title and description together. Reports of one file name (the path's last component, case ignored) and
one set are a class of copies. For each class ``bands`` x ``rows`` minima of universal hashes (odd multiplier, added constant, upper
half) are taken over the set; the minima of a band, with the file name, are a bucket key. Classes of a bucket whose lines come near and whose sketches (one bit
of each of 128 minima) don't rule it out are candidates, which are compared on their whole sets of 32-bit word hashes. Records of a class, or of two similar classes, are linked if their lines are
near: through bins of ``line_gap + 1`` lines.

Hot keys are split without loss: a bucket of more than about ``SLICE`` classes (found on every 64th class) is cut into slices that meet
two by two under keys of their own, and so are the members of a class of more than ``SLICE`` records (found on every 64th record). Groups need no pairs of records:
the records of a class in one bin are one node, and only the nodes are linked, so copies cost what their number is.

At the threshold of 0.7 a pair is missed with a probability of (1 - 0.7^3)^20, about 1 in 4,500, by the bands; the sketches add at most
``SKETCH_MISS``, 1 in 100,000, by a binomial count. Above the threshold both are far less.

Defined results: a null or empty description, a null path or a null key take no part; a null title counts as empty; a line that is null
or 0 is near to any; rows with one key are one record. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import components
from auditlake.session import checkpointed, spread, stored

THRESHOLD, LINE_GAP, BANDS, ROWS, SKETCH, SKETCH_MISS, SEED = 0.7, 8, 20, 3, 128, 1e-5, 7919
WORD = re.compile(r"[a-z0-9_]+")
NO_LINE, ANY_LINE = -1, -2
#: Classes of a bucket, and records of a class, that one key holds; bytes of band rows to a partition at most.
SLICE, PART_BYTES = 4096, 64 << 20


def hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """n universal hashes of 64-bit words: odd multipliers and constants."""
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.int64).max
    return rng.integers(0, top, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, top, n).astype(np.uint64)


def minima(flat: np.ndarray, starts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash over each set: (sets, hashes). ``flat`` holds the words' hashes, ``starts`` where each set begins."""
    a, b = family
    out = np.empty((len(starts), len(a)), np.uint32)
    for i in range(len(a)):
        out[:, i] = np.minimum.reduceat(((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def word_sets(df: DataFrame, key: str) -> DataFrame:
    """(k, line, cls, base, words array<int>) of every report that takes part: its class, file name hash and sorted word hashes."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets, classes, bases = [], [], []
            for title, text, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if len(known) > 500_000:
                    known.clear()
                own = []
                for w in set(WORD.findall(f"{title or ''} {text}".lower())):
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    own.append(h)
                own = np.sort(np.array(own, np.uint64))
                base = xxhash.xxh3_64_intdigest(re.split(r"[/\\]", path)[-1].lower())
                sets.append((own >> np.uint64(32)).astype(np.uint32))
                bases.append(base)
                classes.append(xxhash.xxh3_64_intdigest(own.tobytes(), seed=base))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.uint32)]).view(np.int32)))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (classes, bases)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, words], names=["k", "line", "cls", "base", "words"])

    part = df.where((F.length("description") > 0) & F.col("file_path").isNotNull() & F.col(key).isNotNull())
    cols = part.select(F.col(key).alias("k"), F.col("line_start").cast("int").alias("line"), "title", "description", "file_path")
    return spread(cols).mapInArrow(run, f"k {kind}, line int, cls long, base long, words array<int>")


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, cls, s0, s1, lines): a bucket key of each band, the sketch of the class (a bit of each of ``SKETCH`` minima), and its first line and the number of lines that follow to its last."""
    n = bands * rows
    family = hash_family(max(n, SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            full = sizes > 0  # a text without a word has no near-duplicate but its copies
            if not full.any():
                continue
            flat = np.asarray(lists.flatten()).view(np.uint32).astype(np.uint64)
            starts = np.r_[0, np.cumsum(sizes[full])[:-1]].astype(np.int64)
            low = minima(flat * np.uint64(0x9E3779B97F4A7C15), starts, family)
            base = np.asarray(b.column(1)).view(np.uint64)[full]
            keys = base[:, None] + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            for r in range(rows):
                keys = (keys ^ low[:, r:n:rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            bits = np.packbits((low[:, :SKETCH] & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
            cls, lines = (np.asarray(b.column(i))[full] for i in (0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *(pa.array(np.repeat(c, bands)) for c in (cls, bits[:, 0], bits[:, 1], lines))], names=["band", "cls", "s0", "s1", "lines"])

    return classes.select("cls", "base", "words", F.expr("shiftleft(bigint(lo), 32) | (bigint(hi) - bigint(lo))").alias("lines")).mapInArrow(run, "band long, cls long, s0 long, s1 long, lines long")


def _small(df: DataFrame, n: int, most: int = 200_000) -> DataFrame:
    """``df`` of n narrow rows, broadcast where that is small."""
    return F.broadcast(df) if n <= most else df


def _sliced(buckets: DataFrame, sample: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """The band rows with a slice s, and the cell in which two slices meet; only buckets that the sample (every 64th class) shows hot are cut."""
    hot = checkpointed(sample.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") * 64 > size).select("band", F.ceil(F.col("n") * 64 / size).cast("int").alias("slices")))
    n = hot.count()
    if not n:
        return buckets, False
    x = buckets.join(_small(hot, n), "band", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    x = x.withColumn("s", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int")).withColumn("t", F.explode(F.expr("sequence(0, slices - 1)")))
    return x.select(F.xxhash64("band", F.least("s", "t"), F.greatest("s", "t")).alias("cell"), F.col("band"), "cls", "s0", "s1", "lines", F.when(F.col("s") != F.col("t"), F.col("s")).otherwise(-1).alias("s")), True


def _classes(sets: DataFrame) -> DataFrame:
    """(cls, base, words, lo, hi): the classes, with the lines that they span; all lines if one is unknown."""
    line = F.nullif("line", F.lit(0))
    open_ = F.bool_or(line.isNull())
    edge = lambda f, far: F.when(open_, F.lit(far)).otherwise(f(line)).cast("int")
    return sets.where("cls is not null").groupBy("cls").agg(F.any_value("base").alias("base"), F.any_value("words").alias("words"), edge(F.min, -(1 << 31)).alias("lo"), edge(F.max, (1 << 31) - 1).alias("hi"))


def similar_classes(sets: DataFrame, threshold: float, line_gap: int, bands: int, rows: int, size: int = SLICE) -> DataFrame:
    """(c1, c2), c1 < c2: the classes that share a bucket, whose lines may be near, whose sketches don't rule it out, and whose sets reach the threshold."""
    classes = _classes(sets)
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() * bands * 40 // PART_BYTES))
    buckets = band_rows(classes, bands, rows)
    sample = band_rows(_classes(sets.where("pmod(cls, 64) = 0")), bands, rows)
    buckets, cut = _sliced(buckets, sample, size)
    key = ["cell", "band"] if cut else ["band"]
    buckets = buckets.repartition(n, *key)
    x = buckets.withColumnsRenamed({"cls": "c1", "s0": "x0", "s1": "x1", "s": "t1", "lines": "l1"})
    y = buckets.withColumnsRenamed({"cls": "c2", "s0": "y0", "s1": "y1", "s": "t2", "lines": "l2"})
    # Two slices meet in a cell for their mixed pairs alone; -1 marks the cell of a slice with itself.
    mixed = "(t1 = -1 and t2 = -1 or t1 <> t2)" if cut else "true"
    first, last = (lambda i: f"shiftright(l{i}, 32)"), (lambda i: f"shiftright(l{i}, 32) + (l{i} & 4294967295)")
    lines = f"{first(1)} - {line_gap} <= {last(2)} and {first(2)} - {line_gap} <= {last(1)}"
    pairs = x.join(y, key).where(f"c1 < c2 and {lines} and {mixed} and bit_count(x0 ^ y0) + bit_count(x1 ^ y1) <= {most_differing(threshold)}").select("c1", "c2").repartition("c1").distinct()
    # Reading every column, as the band rows do, lets one exchange of the classes serve all.
    classes = classes.where("base is not null and lo <= hi")
    # Half of each word's hash goes first: what it has in common, and one for each two words of a set that fall together, bounds what the words have.
    half = F.array_distinct(F.transform("words", lambda w: (w.bitwiseAND(65535) - 32768).cast("short")))
    halves = classes.select("cls", half.alias("h"), F.size("words").alias("n"))
    both = pairs.join(halves.withColumnsRenamed({"cls": "c1", "h": "h1", "n": "n1"}), "c1").join(halves.withColumnsRenamed({"cls": "c2", "h": "h2", "n": "n2"}), "c2")
    most = F.size(F.array_intersect("h1", "h2")) + F.col("n1") - F.size("h1")
    pairs = both.where(_reach(most, F.col("n1"), F.col("n2"), threshold)).select("c1", "c2")
    words = classes.select("cls", F.col("words").alias("w"))
    both = pairs.join(words.withColumnsRenamed({"cls": "c1", "w": "w1"}), "c1").join(words.withColumnsRenamed({"cls": "c2", "w": "w2"}), "c2")
    return both.where(_reach(F.size(F.array_intersect("w1", "w2")), F.size("w1"), F.size("w2"), threshold)).select("c1", "c2")


def _reach(common: Column, n1: Column, n2: Column, threshold: float) -> Column:
    """Two sets with so much in common reach the threshold; in whole numbers, so that a pair at the threshold isn't lost to rounding."""
    return common * 1000 >= (n1 + n2 - common) * round(threshold * 1000)


def most_differing(threshold: float, miss: float = SKETCH_MISS) -> int:
    """The least number of sketch bits that a pair at the threshold exceeds with a probability below ``miss``: its minima differ with 1 - threshold, and then half of their bits."""
    p = (1 - threshold) / 2
    k, tail = SKETCH, 0.0
    while k > 0 and (tail := tail + comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) < miss:
        k -= 1
    return k


def _members(sets: DataFrame) -> DataFrame:
    """(cls, k, line): each record once, partitioned by class; an unknown line is null."""
    return sets.select("cls", "k", F.when(F.col("line") != 0, F.col("line")).alias("line")).repartition("cls").distinct()


def _cut_members(sets: DataFrame, members: DataFrame, links: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Members with a slice s of their class, and links for every two slices (s1, s2), if a sample shows a class of more than ``size`` records; only those are cut."""
    every = min(64, size)
    n_ = F.col("n") * every
    sample = sets.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).groupBy("cls").agg(F.count("*").alias("n"))
    hot = checkpointed(sample.where(n_ > size).select("cls", F.ceil(n_ / size).cast("int").alias("slices")))
    n = hot.count()
    if not n:
        return members, links
    small = _small(hot, n)
    members = members.join(small, "cls", "left").withColumn("s", F.pmod(F.xxhash64("k"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    for c, s in (("c1", "s1"), ("c2", "s2")):
        links = links.join(small.withColumnRenamed("cls", c), c, "left").withColumn(s, F.explode(F.expr("sequence(0, coalesce(slices, 1) - 1)"))).drop("slices")
    return members, links


def near_pairs(df: DataFrame, key: str = "arrival_seq", threshold: float = THRESHOLD, line_gap: int = LINE_GAP, bands: int = BANDS, rows: int = ROWS, size: int = SLICE) -> DataFrame:
    """(a, b), a < b: every pair of records of one report."""
    sigs = stored(word_sets(df, key))
    similar = similar_classes(sigs, threshold, line_gap, bands, rows, size)
    members = _members(sigs)
    copies = members.groupBy("cls").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x < y")
    links = similar.unionByName(copies.select(F.col("cls").alias("c1"), F.col("cls").alias("c2")))
    members, links = _cut_members(sigs, members, links, size)
    bin_ = F.floor(F.col("line") / (line_gap + 1))
    left_keys = F.when(F.col("line").isNull(), F.array(F.lit(ANY_LINE).cast("long"))).otherwise(F.array(F.lit(NO_LINE).cast("long"), bin_ * 4, (bin_ - 1) * 4, (bin_ + 1) * 4))
    right_keys = F.when(F.col("line").isNull(), F.array(F.lit(NO_LINE).cast("long"), F.lit(ANY_LINE).cast("long"))).otherwise(F.array(bin_ * 4, F.lit(ANY_LINE).cast("long")))
    keys = ["cls", "s"] if "s" in members.columns else ["cls"]
    by = {"cls": ["c1", "c2"], "s": ["s1", "s2"]}
    left = links.join(members.withColumnsRenamed({"k": "ka", "line": "la"} | {c: by[c][0] for c in keys}), [by[c][0] for c in keys])
    right = links.join(members.withColumnsRenamed({"k": "kb", "line": "lb"} | {c: by[c][1] for c in keys}), [by[c][1] for c in keys])
    cell = [x for c in keys for x in by[c]]
    left = left.withColumn("line", F.col("la")).select(*cell, "ka", "la", F.explode(left_keys).alias("at"))
    right = right.withColumn("line", F.col("lb")).select(*cell, "kb", "lb", F.explode(right_keys).alias("at"))
    met = left.join(right, [*cell, "at"]).where("(c1 <> c2 or ka < kb) and ka <> kb")
    met = met.where(F.col("la").isNull() | F.col("lb").isNull() | (F.abs(F.col("la") - F.col("lb")) <= line_gap))
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def near_groups(df: DataFrame, key: str = "arrival_seq", threshold: float = THRESHOLD, line_gap: int = LINE_GAP, bands: int = BANDS, rows: int = ROWS, size: int = SLICE) -> DataFrame:
    """(node, component, n_members, n_links) of the records that have a near-duplicate: the components of near_pairs(), without its pairs.

    The records of a class in one bin of lines are all linked, hence one node, named by its smallest record; those of unknown line are a
    node that every bin of the class is linked to. Nodes of one bin are linked if their classes are similar, nodes of neighbouring bins
    if their nearest lines are. ``n_links`` counts the linked nodes of a record's node.
    """
    sigs = stored(word_sets(df, key))
    bin_ = F.floor(F.col("line") / (line_gap + 1))
    placed = _members(sigs).withColumn("bin", bin_)
    nodes = checkpointed(placed.groupBy("cls", "bin").agg(F.min("k").alias("node"), F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi")))
    similar = similar_classes(sigs, threshold, line_gap, bands, rows, size)
    links = similar.unionByName(nodes.select("cls").distinct().select(F.col("cls").alias("c1"), F.col("cls").alias("c2")))
    known, unknown = nodes.where("bin is not null"), nodes.where("bin is null").select("cls", "node")
    a = links.join(known.select(F.col("cls").alias("c1"), F.col("node").alias("u"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.expr("array(bin - 1, bin, bin + 1)")).alias("bin")), "c1")
    met = a.join(known.select(F.col("cls").alias("c2"), "bin", F.col("node").alias("v"), "lo", "hi"), ["c2", "bin"]).where(f"u <> v and lo - hi1 <= {line_gap} and lo1 - hi <= {line_gap}").select("u", "v")
    both = links.unionByName(links.where("c1 <> c2").select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    any_ = both.join(unknown.select(F.col("cls").alias("c1"), F.col("node").alias("u")), "c1").join(nodes.select(F.col("cls").alias("c2"), F.col("node").alias("v")), "c2").where("u <> v").select("u", "v")
    edges = checkpointed(met.unionByName(any_).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found = components(edges, "u", "v").withColumnsRenamed({"node": "u"})
    degree = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    at = nodes.select(F.col("node").alias("u"), "cls", "bin", "n").join(found, "u", "left").join(degree, "u", "left").withColumn("component", F.coalesce("component", "u"))
    total = at.groupBy("component").agg(F.sum("n").alias("n_members")).where("n_members > 1")
    at = at.join(total, "component").select("cls", "bin", "component", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = placed.select("cls", "bin", "k").join(at.withColumnsRenamed({"cls": "_c", "bin": "_b"}), (F.col("cls") == F.col("_c")) & F.col("bin").eqNullSafe(F.col("_b")))
    return own.select(F.col("k").alias("node"), "component", "n_members", "n_links")
