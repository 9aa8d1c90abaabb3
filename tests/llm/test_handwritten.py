import random

from auditlake.llm import handwritten as H

WORDS = "anchor basket cursor depot engine ferry gauge harbor index journal kiosk lantern".split()


def hand(rng):
    return "import os\n\n\n" + "\n\n".join(f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}(a, b={rng.randrange(99)}):\n    # {' '.join(rng.sample(WORDS, 4))}\n    if a is None:\n        return b\n    return [x for x in a if x > {rng.randrange(99)}]" for _ in range(rng.randrange(4, 9)))


def made(rng):
    return "\n".join(f"_{rng.choice(WORDS).upper()}_{i} = _reg.add_field(name='{rng.choice(WORDS)}_{i}', index={i}, number={i + 1}, type={rng.randrange(9)})" for i in range(rng.randrange(15, 40)))


def small(rng):
    return ";".join(f"function {chr(97 + i % 26)}{i}(e,t){{var n=e.{rng.choice(WORDS)}||{i},r=[];for(var i=0;i<n;i++)r.push(t(e[i]));return r}}" for i in range(rng.randrange(20, 40)))


def data(rng):
    return "TABLE = [\n" + "\n".join("    " + " ".join(f"0x{rng.randrange(256):02x}," for _ in range(12)) for _ in range(60)) + "\n]"


def corpus(n=700):
    rng = random.Random(5)
    libs = [("tinylib", "https://git.example/own/tinylib", hand(rng)) for _ in range(3)]
    rows, truth = [], {}
    for i in range(n):
        repo = f"https://git.example/team/app-{i % 12}"
        kind = rng.choice(["hand"] * 6 + ["made", "made-head", "small", "data", "copy", "home"])
        text, path = hand(rng), f"src/{rng.choice(WORDS)}_{i}.py"
        if kind.startswith("made"):
            text = ("# Code generated by maker v1. DO NOT EDIT.\n" if kind == "made-head" or rng.random() < 0.5 else "") + made(rng)
        elif kind == "small":
            text, path = small(rng), f"src/{rng.choice(WORDS)}{i}.js"
        elif kind == "data":
            text = data(rng)
        elif kind in ("copy", "home"):
            text = "# Taken from https://git.example/own/tinylib/blob/main\n" + libs[i % 3][2]
            repo = "http://Git.example/own/tinylib.git/" if kind == "home" else repo
        rows.append((f"r{i}", i, path, text, repo))
        truth[f"r{i}"] = kind not in ("hand", "home")
    return rows, truth, libs


def test_classifier(spark):
    rows, truth, libs = corpus()
    extra = [("x1", 1, None, "x", None), ("x2", 1, "a.py", None, None), ("x3", 1, "a.py", " ", None), ("x4", 1, "conf/a.yml", "# Code generated by maker. DO NOT EDIT.\n" + "a: 1\n" * 40, None), ("x5", 1, "gen/emit.py", hand(random.Random(1)) + "\n\n\ndef head(out):\n    out.write('Code generated by {tool}. DO NOT EDIT.')\n", None)]
    files = spark.createDataFrame([(a, b, c, t, "clash") for a, b, c, t, _ in rows + extra + rows[:5]], "review_id string, file_seq int, path string, content string, kinds string")
    tasks = spark.createDataFrame([(a, r, "2025-01-01") for a, _, _, _, r in rows] + [("r1", None, "2026-01-01")], "review_id string, repo_url string, updated_at string")
    known = spark.createDataFrame(libs, "lib_name string, home_url string, content string")
    found, model = H.judged(files, tasks, known)
    got = {r.review_id for r in found.collect()}
    want = {k for k, v in truth.items() if v}
    assert not got & {"x1", "x2", "x3", "x4", "x5"}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    assert model.held_out["minified"][1] > 0.9
    assert H.not_handwritten(files.limit(0), tasks, known).count() == 0


def test_masking_and_repos(spark):
    head, body = H.head_and_body("/*\n * Generated by x. DO NOT EDIT\n */\n// more\n\ncode();\n// tail\n")
    assert "DO NOT EDIT" in head and body == "code();\n// tail\n"
    urls = ["https://git.example/a/b", " http://Git.example/a/b.git ", "https://git.example/a/b/tree/main", "git@git.example:a/b.git", "https://git.example/a/b/", None, "nonsense"]
    from pyspark.sql import functions as F

    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").select(H.canonical_repo(F.col("u")).alias("u")).collect()]
    assert got == ["git.example/a/b"] * 5 + [None, None]
