import itertools
import random
import re

from auditlake.llm import components as K
from auditlake.llm import neardup as N


def brute(rows):
    sets = {}
    for k, title, text, path, line in rows:
        if k is not None and text and path is not None:
            sets[k] = (set(re.findall("[a-z0-9_]+", f"{title or ''} {text}".lower())), re.split(r"[/\\]", path)[-1].lower(), line)
    out = set()
    for (a, (s, p, x)), (b, (t, q, y)) in itertools.combinations(sorted(sets.items()), 2):
        same = s == t or len(s & t) * 10 >= 7 * len(s | t) and s | t
        if p == q and same and (not x or not y or abs(x - y) <= 8):
            out.add((a, b))
    return out


SCHEMA = "arrival_seq long, title string, description string, file_path string, line_start int, cls string"


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    base = [rng.sample(words, 12) for _ in range(12)]
    for i in range(400):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b[:3]).title(), " ".join(b[3:]), rng.choice(["src/A.py", "lib\\a.py", "b.py"]), rng.choice([None, 0, 5, 9, 13, 14, 22, 23, 40])))
    rows += [(900, None, None, "b.py", 1), (901, None, "", "b.py", 1), (902, "x", "y", None, 1), (903, None, "alpha beta", "b.py", 1), (904, "alpha", "beta", "x/b.py", 3), (905, "!!", "??", "b.py", 3), (906, "..", "--", "b.py", 3)]
    want = brute(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:40]], SCHEMA)
    got = {(r.a, r.b) for r in N.near_pairs(df).collect()}
    assert not got - want
    assert len(want - got) <= len(want) * 0.002 and len(want) > 500
    assert (903, 904) in got
    cut = {(r.a, r.b) for r in N.near_pairs(df, size=3).collect()}  # nearly every bucket and class in slices
    assert cut == got
    assert grouped(N.near_groups(df)) == grouped(N.near_groups(df, size=3)) == parts(got)


def parts(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def grouped(df):
    rows = df.collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    assert all(r.n_members == sum(c == r.component for c in out.values()) for r in rows[:20])
    return out


def test_many_copies_are_few_nodes(spark):
    rows = [(i, "t", "one two three four", "a.py", (i % 40) * 30 if i % 3 else None, "x") for i in range(3000)]
    got = grouped(N.near_groups(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 3000 and set(got.values()) == {0}
    apart = grouped(N.near_groups(spark.createDataFrame([r for r in rows if r[4] is not None and r[4]], SCHEMA)))
    assert len(set(apart.values())) == 39


def test_empty(spark):
    assert N.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7), (None, 3)]
    want = parts({(a, b) for a, b in edges if a is not None and a != b})
    got = {r.node: r.component for r in K.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want
    assert K.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sketches_add_little_to_the_misses():
    from math import comb

    from auditlake.llm import neardup

    k, p = neardup.most_differing(0.7), 0.3 / 2
    tail = lambda k: sum(comb(128, i) * p**i * (1 - p) ** (128 - i) for i in range(k + 1, 129))
    assert tail(k) < 1e-5 <= tail(k - 1)
