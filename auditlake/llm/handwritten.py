"""Files that nobody in the repository wrote by hand: generated, minified, data kept as code, or copied in from another project.

One linear support-vector classifier per kind is trained on hashed character n-grams (4 and 6 bytes, digits levelled), path components
and a few measures of shape. Giveaway comments at the head of a file (generation notices, licences) are masked, so that the classifiers
learn from the body; the notices only serve as labels. Every record is fitted on: the records are dealt by hash into shards of about
``SHARD_ROWS``, each shard trains a model of its own, and the models are averaged by the shards' rows (parallelized stochastic gradient
descent); a shard without an example of a kind has no say in that kind. Validation holds out whole repositories. A notice at the head then
lowers the bar for the classifier that it names.

The lines that many of all texts hold that are no library's (imports, loggers and the like) say nothing of an origin.

A file taken for a library's is checked exactly: its origin (a homepage named at its head, the known library that its lines come from, or
the library named by its path) must not be the file's own repository. An unknown repository counts as another one.

Defined results: only the project's code extensions are judged; null, empty and blank contents, null paths and all other files are
hand-written. A null or unknown repo_url, or a review without task, is no home of any library. Redelivered rows are one record, in
fitting too. A kind without a labelled row finds nothing. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import spread

#: Records that are trained on together, and models that are added up together.
SHARD_ROWS, FAN = 4000, 16
#: Rounds over a shard's records: as many as there are for one shard, shared by all, yet at least the second number.
EPOCHS = (60, 12)
DIMS, PATH_DIMS, SEED = 1 << 14, 1 << 11, 17
#: Steps of the fixed-point numbers in which models are added up, so that their order doesn't matter.
FIXED = 1 << 24
KINDS = ["generated", "minified", "data", "library"]
#: A table of known libraries larger than this is refused: it is sent to every worker.
MOST_LIBRARY_FILES = 20_000
#: Different texts that make a library's line a common one: so many, and this share of all different texts. Lines of its own that a copy shares at least.
COMMON_FILES, COMMON_SHARE, LEAST_SHARED = 3, 0.001, 5

# The project's code extensions, wordings of generation notices, and folders of third-party code.
CODE = r"(?i)\.(py|js|jsx|ts|tsx|go|java)$"
NOTICE = re.compile(
    r"(?i)generated by|auto-?generated|automatically generated|do not edit|@generated|<auto-generated|code generated|machine[- ](?:written|generated|made)|this file (?:was|is) (?:automatically |auto-?)?(?:generated|produced|created|written)"
    r"|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée] (?:automatiquement|par)|generado (?:autom|por)|gerado (?:autom|por)|自动生成|自動生成|сгенерирован|создано автоматически"
)
NOT_NOTICE = re.compile(r"(?i)by hand|edit freely|nicht automatisch|emitted files start|every file we emit")
ORIGIN = re.compile(r"(?:https?://|git@)([\w.-]+[/:][\w.-]+/[\w.-]+)")
ATTRIBUTED = re.compile(r"(?i)taken from|@package|@homepage|part of [\w.-]+ |copied from|vendored|originally from|imported from|\bv?\d+\.\d+\.\d+\b|upstream|adapted from|source:")
THIRD_PARTY = {"node_modules", "bower_components", "vendor", "third_party", "thirdparty", "third-party", "_vendor", "site-packages", "godeps", "external", "externals", "jspm_packages", "deps"}
COMMENT = ("#", "//", "/*", "*", "<!--", "--", ";")
LITERAL = re.compile(r"[A-Za-z0-9+/=]{60,}+|(?:0x[0-9A-Fa-f]++|-?\d++(?:\.\d++)?+)(?:\s*+,\s*+(?:0x[0-9A-Fa-f]++|-?\d++(?:\.\d++)?+)){7,}+")
#: Words that code holds and data doesn't.
CODE_WORD = re.compile(r"\b(?:def|class|return|import|from|function|func|if|else|for|while|public|private|void|interface|package|new|try|await)\b|=>|\(\w*\)")
DIGITS = bytes.maketrans(b"123456789", b"000000000")
# Bytes of LITERAL's runs, and those that its numbers and the blanks between them may hold.
RUNS = bytes(97 if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=" else 32 for i in range(256))
NUMBERS = bytes(i for i in range(256) if i >= 128 or chr(i) in "0123456789abcdefABCDEFxX.-" or chr(i).isspace())


def canonical_repo(url: Column) -> Column:
    """host/owner/name in lower case, whatever the spelling."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"^(?:[a-z+]+://)?(?:[^/@]*@)?", "")
    u = F.regexp_replace(u, r"^([^/:]+):", "$1/")
    u = F.regexp_extract(u, r"^([^/]+/[^/]+/[^/?#]+)", 1)
    u = F.regexp_replace(u, r"\.git$", "")
    return F.when(u != "", u)


def canonical_text(url: str) -> str:
    """The same of a URL found in a text."""
    u = re.sub(r"^(?:[a-z+]+://)?(?:[^/@]*@)?", "", url.strip().lower()).replace(":", "/", 1)
    parts = u.split("/")[:3]
    return re.sub(r"[.,;]+$", "", "/".join(parts)).removesuffix(".git")


def head_length(lines: list[str]) -> int:
    """How many lines the leading comment block has."""
    i, block = 0, False
    while i < len(lines):
        s = lines[i].strip()
        if block:
            block = "*/" not in s
        elif s.startswith("/*"):
            block = "*/" not in s[2:]
            if not block and s.split("*/", 1)[1].strip():
                break
        elif s and not s.startswith(("#", "//", "*", "<!--", "-->")):
            break
        i += 1
    return i


def head_and_body(text: str) -> tuple[str, str]:
    """The leading comment block, and the rest."""
    lines = text.split("\n")
    i = head_length(lines)
    return "\n".join(lines[:i]), "\n".join(lines[i:])


def line_hashes(lines: list[str]) -> list[int]:
    return list(map(xxhash.xxh3_64_intdigest, lines))


def body_lines(lines: list[str]) -> list[str]:
    return [s for x in lines if len(s := x.strip()) > 8 and not s.startswith(COMMENT)]


@dataclass
class Libraries:
    """Lines (by hash), names and homes of the known libraries' files, and the lines that other code holds as well."""

    lines: dict[int, list[int]] = field(default_factory=dict)
    common: set[int] = field(default_factory=set)
    homes: list[str] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str, str]]) -> Libraries:
        """rows: (lib_name, home_url, content)."""
        out = cls()
        for name, home, content in rows:
            if not home:
                continue
            i = len(out.homes)
            out.homes.append(canonical_text(home))
            if name:
                out.names[name.lower()] = out.homes[i]
            for h in set(line_hashes(body_lines((content or "").split("\n")))):
                out.lines.setdefault(h, []).append(i)
        return out

    @cached_property
    def telling(self) -> frozenset[int]:
        """The lines that say something of an origin."""
        return frozenset(self.lines.keys() - self.common)

    def overlap(self, hashes: list[int]) -> tuple[float, int, str | None]:
        """The largest share of the lines (hashes) that one library file holds, how many these are, and its home; lines that any code may hold don't count."""
        if self.telling.isdisjoint(hashes):
            return 0.0, 0, None
        own = [h for h in hashes if h not in self.common]
        n: dict[int, int] = {}
        for h in own:
            for i in self.lines.get(h, ()):
                n[i] = n.get(i, 0) + 1
        best = max(n, key=lambda i: (n[i], -i))
        return n[best] / len(own), n[best], self.homes[best]

    def unexplained(self, text: str) -> set[int]:
        """The library lines in a text that no library file explains by half."""
        lines = text.split("\n")
        hashes = line_hashes(body_lines(lines[head_length(lines) :]))
        held = self.lines.keys() & hashes
        return held if held and self.overlap(hashes)[0] < 0.5 else set()


@dataclass
class Seen:
    """What is read from one file."""

    body: str
    raw: bytes  # the body in UTF-8
    notice: bool
    origin: str | None  # canonical home of the project it comes from, as far as told
    overlap: float
    third_party: bool
    literal: int
    blanks: int
    data: bool
    shape: list[int]


def literal_length(body: str, raw: bytes) -> int:
    """Characters in long runs of encoded text or numbers; the expression runs only where such a run or eight numbers are possible."""
    if b"a" * 60 not in raw.translate(RUNS) and b"," * 7 not in raw.translate(None, NUMBERS):
        return 0
    return sum(len(m.group()) for m in LITERAL.finditer(body))


def data_only(body: str, literal: int) -> bool:
    """Little but literals: long runs of encoded text or numbers, or hardly a word of code in a body of some length."""
    n = len(body)
    if n > 300 and literal > 0.6 * n:
        return True
    enough = -(-n // 1000)
    return n > 700 and sum(1 for _ in islice(CODE_WORD.finditer(body), enough)) < enough


def look(path: str, text: str, libs: Libraries) -> Seen:
    """The masked body, and the evidence beside it."""
    all_lines = text.split("\n")
    i = head_length(all_lines)
    head, body = ("\n".join(all_lines[:i]), "\n".join(all_lines[i:])) if i else ("", text)
    all_lines = all_lines[i:] or [""]
    notice = bool(head and NOTICE.search(head)) and not NOT_NOTICE.search(head)
    share, shared, home = libs.overlap(line_hashes(body_lines(all_lines)))
    parts = [x for x in path.lower().replace("\\", "/").split("/") if x not in ("", ".")]
    folders = set(parts[:-1])
    third = bool(folders & THIRD_PARTY)
    origin = None
    if share >= 0.6 and shared >= LEAST_SHARED:
        origin = home
    if origin is None and head and ATTRIBUTED.search(head) and (m := ORIGIN.search(head)):
        origin = canonical_text(m.group(1))
    if origin is None and third:
        for x in parts[:-1]:
            if (lib := libs.names.get(re.sub(r"[-@]v?\d[\w.]*$", "", x))) is not None:
                origin = lib
                break
    n = max(1, len(body))
    longest = max(map(len, all_lines))
    raw = body.encode("utf-8", "replace")
    blanks, digits = (len(raw) - len(raw.translate(None, x)) for x in (b" \n\t\r", b"0123456789"))
    literal = literal_length(body, raw)
    data = data_only(body, literal)
    shape = [
        min(15, longest.bit_length()),
        16 + min(15, (n // len(all_lines)).bit_length()),
        32 + min(9, blanks * 30 // n),
        42 + min(9, digits * 30 // n),
        52 + min(9, literal * 10 // n),
        62 + min(4, int(share * 5)),
        67 + (origin is not None),
        69 + third,
        71 + min(15, n.bit_length()),
        87 + data,
    ]
    return Seen(body, raw, notice, origin, share, third, literal, blanks, data, shape)


SHAPE_DIMS = 90
WIDTH = DIMS + PATH_DIMS + SHAPE_DIMS
BETWEEN_WORDS = re.compile(r"[_\-.\d]+")
#: Values of the columns of a path and of a shape.
PATH_VALUES = np.array([0.25, 0.35], np.float32)
# Factors of the n-grams' hashes (four bytes, six, the last two of six), and the shifts and offset of their columns.
MIX = tuple(map(np.uint32, (0x9E3779B1, 0xC2B2AE35, 0x85EBCA6B, 16, 19, DIMS // 2)))


@lru_cache(1 << 14)
def path_column(name: str) -> int:
    h = 0
    for ch in name.encode():
        h = (h * 0x01000193 ^ ch) & 0xFFFFFFFF
    return DIMS + h % PATH_DIMS


def features(path: str, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by square-rooted share (a unit vector), path components, shape: the columns that aren't zero, and their values."""
    columns, values = np.empty(0, np.uint16), np.empty(0, np.float32)
    raw = seen.raw.translate(DIGITS)
    if (n := len(raw) - 3) >= 3:
        four = np.ndarray((n,), "<u4", raw, 0, (1,)).copy()  # the four bytes from each one on
        both = np.empty(2 * n - 2, np.uint32)
        six = both[n:]
        np.multiply(four, MIX[0], out=both[:n])
        np.right_shift(four[2:], MIX[3], out=six)
        six *= MIX[2]
        six ^= four[:-2]
        six *= MIX[1]
        both >>= MIX[4]
        six += MIX[5]
        both = np.sort(both.astype(np.uint16), kind="stable")  # by radix, whatever the processor
        last = np.append(np.flatnonzero(both[1:] != both[:-1]), len(both) - 1)
        columns = both.take(last)
        counts = last.copy()
        counts[0] += 1
        counts[1:] -= last[:-1]
        values = np.sqrt(counts / len(both)).astype(np.float32)
    parts = [p for p in path.lower().replace("\\", "/").split("/") if p not in ("", ".")]
    names = [f"/{p}" for p in parts[:-1]] + ([f".{parts[-1].split('.', 1)[-1]}"] if parts else [])
    names += [f"_{w}" for w in BETWEEN_WORDS.split(parts[-1]) if w][-2:] if parts else []
    of_path = sorted(set(map(path_column, names)))
    more = np.array(of_path + [DIMS + PATH_DIMS + x for x in seen.shape], np.uint16)
    return np.concatenate([columns, more]), np.concatenate([values, PATH_VALUES.repeat([len(of_path), len(seen.shape)])])


def labels(seen: Seen, path: str) -> np.ndarray:
    """The kinds that the evidence shows; a file without any is taken as hand-written in training."""
    n = max(1, len(seen.body))
    script = bool(re.search(r"(?i)\.(?:js|jsx|ts|tsx)$", path))
    minified = script and n / (seen.body.count("\n") + 1) > 150 and seen.blanks / n < 0.12 and seen.literal / n < 0.5
    return np.array([seen.notice, minified, seen.data and not seen.notice, seen.origin is not None], bool)


@dataclass
class Model:
    """Weights (by column and kind) and bias per kind."""

    weights: np.ndarray
    bias: np.ndarray
    validate: Callable[[], dict[str, tuple[float, float]]] = dict

    @cached_property
    def held_out(self) -> dict[str, tuple[float, float]]:
        """The held-out scores by kind: (precision, recall); computed when asked for."""
        return self.validate()

    def scores(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values.dot(self.weights.take(columns, 0, mode="clip")) + self.bias


@dataclass
class Examples:
    """Feature vectors (columns and values of each) and their labels."""

    columns: list[np.ndarray]
    values: list[np.ndarray]
    labels: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str]], libs: Libraries) -> Examples:
        """rows: (path, content)."""
        out = cls([], [], np.zeros((len(rows), len(KINDS)), bool))
        for i, (path, text) in enumerate(rows):
            seen = look(path, text, libs)
            columns, values = features(path, seen)
            out.columns.append(columns)
            out.values.append(values)
            out.labels[i] = labels(seen, path)
        return out


def train_svm(examples: Examples, epochs: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hinge loss by stochastic sub-gradients (step 1/(lambda t)), one-against-rest, both sides weighted alike, averaged over the second half."""
    rng = np.random.default_rng(seed)
    y = examples.labels
    n, k = y.shape
    w, b = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    flat = w.reshape(-1)
    mean_w, mean_b, m = np.zeros_like(w), np.zeros_like(b), 0
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    positive = y.sum(0)
    cost = np.where(y, np.clip((n - positive) / np.maximum(1, positive), 1, 12), 1.0).astype(np.float32)
    lam, size, t = 1e-3, 64, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, size):
            i = order[s : s + size]
            t += 1
            rate = min(0.5, 1.0 / (lam * (t + 20)))
            score = np.array([examples.values[j].dot(w.take(examples.columns[j], 0, mode="clip")) for j in i.tolist()]) + b
            miss = (sign[i] * score < 1) * sign[i] * cost[i]
            w *= 1 - rate * lam
            for r, kind in zip(*np.nonzero(miss)):  # few after the first rounds
                flat[examples.columns[i[r]].astype(np.intp) * k + kind] += rate / len(i) * miss[r, kind] * examples.values[i[r]]
            b += 0.1 * rate * miss.mean(0)
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
                m += 1
    return mean_w / max(1, m), mean_b / max(1, m)


def summed(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of the arrays of whole numbers (int64, as bytes) in rows (part, said), part below n; added up by ``FAN`` at a time in the workers, so the driver gets one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = 0, None
        for b in batches:
            for part, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(said, np.int64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part // FAN], pa.int32()), "said": pa.array([total.tobytes()], pa.binary())})

    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartitionById(n, F.expr(f"part div {FAN}").cast("int")).mapInArrow(add, parts.schema)
    rows = parts.collect()
    return np.frombuffer(rows[0]["said"], np.int64) if rows else None


def fit(records: DataFrame, n: int, libs: Callable[[], Libraries]) -> Model:
    """A model of all of about n records (record, path, content); libs is called in the workers."""
    shards = max(1, -(-n // SHARD_ROWS))
    epochs = max(EPOCHS[1], EPOCHS[0] // shards)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {k: (p, t) for b in batches for k, p, t in zip(*(b.column(c).to_pylist() for c in ("record", "path", "content")))}  # redelivered rows once
        if not rows:
            return
        shard = next(iter(rows)) % shards
        examples = Examples.of([rows[k] for k in sorted(rows)], libs())
        w, b = train_svm(examples, epochs)
        say = (examples.labels.any(0) * len(rows)).astype(np.int64)
        said = np.rint(np.vstack([w, b]).astype(np.float64) * FIXED).astype(np.int64) * say
        yield pa.RecordBatch.from_pydict({"part": pa.array([shard], pa.int32()), "said": pa.array([np.vstack([said, say]).tobytes()], pa.binary())})

    dealt = records.repartitionById(shards, F.pmod("record", F.lit(shards)).cast("int"))
    total = summed(dealt.mapInArrow(train, "part int, said binary"), shards)
    if total is None:
        return Model(np.zeros((WIDTH, len(KINDS)), np.float32), np.full(len(KINDS), -9, np.float32))
    sums = total.reshape(WIDTH + 2, len(KINDS))
    mean = (sums[:-1] / FIXED / np.maximum(1, sums[-1])).astype(np.float32)
    mean[-1, sums[-1] == 0] = -9  # no example of this kind
    return Model(mean[:-1], mean[-1])


def judge(path: str, text: str, model: Model, libs: Libraries) -> tuple[list[str], str | None]:
    """The kinds found, and the origin of a library's file."""
    seen = look(path, text, libs)
    s = model.scores(*features(path, seen))
    s[0] += 4.0 if seen.notice else 0.0
    s[3] += 0.5 if seen.origin is not None else 0.0
    return [k for k, v in zip(KINDS, s) if v > 0], seen.origin


def repos_of_reviews(tasks: DataFrame) -> DataFrame:
    """(review_id, repo): the canonical repository of each review's latest delivery."""
    latest = F.max_by("repo_url", F.struct(F.col("updated_at").isNotNull(), "updated_at"))
    known = F.max("repo_url")  # a delivery without url doesn't take away what another one told
    return tasks.where("review_id is not null").groupBy("review_id").agg(canonical_repo(F.coalesce(latest, known)).alias("repo"))


def library_rows(libs: DataFrame) -> list[tuple[str, str, str]]:
    rows = libs.select("lib_name", "home_url", "content").limit(MOST_LIBRARY_FILES + 1).collect()
    if len(rows) > MOST_LIBRARY_FILES:
        raise ValueError(f"more than {MOST_LIBRARY_FILES} library files")
    return [tuple(r) for r in rows]


def common_lines(records: DataFrame, libs: Callable[[], Libraries]) -> tuple[int, set[int]]:
    """How many different records (record, text, content) there are, and the library lines that ``COMMON_FILES`` different texts hold that no library file explains by half, and ``COMMON_SHARE`` of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = libs()
        for b in batches:
            texts = b.column("text").to_pylist()
            held = [known.unexplained(text) for text in b.column("content").to_pylist()]
            lines = [(h - (1 << 63), text) for text, x in zip(texts, held) for h in x]
            what = ["record"] * len(texts) + ["text"] * len(texts) + ["line"] * len(lines)
            line = [None] * (2 * len(texts)) + [h for h, _ in lines]
            by = b.column("record").to_pylist() + texts + [text for _, text in lines]
            yield pa.RecordBatch.from_pydict({"what": pa.array(what, pa.string()), "line": pa.array(line, pa.int64()), "by": pa.array(by, pa.int64())})

    counts = records.mapInArrow(run, "what string, line long, by long").groupBy("what", "line").agg(F.count_distinct("by").alias("n"))
    rows = counts.where((F.col("what") != "line") | (F.col("n") >= COMMON_FILES)).collect()  # one for each library line at most
    n, texts = (sum(r["n"] for r in rows if r["what"] == what) for what in ("record", "text"))
    return n, {r["line"] + (1 << 63) for r in rows if r["what"] == "line" and r["n"] >= COMMON_SHARE * texts}


def fifth(repos: pd.Series) -> pd.Series:
    """Whether a repository ("" where it is unknown) is one of every fifth, by hash."""
    return pd.util.hash_pandas_object(repos.fillna(""), index=False) % 5 == 0


def held_out_scores(records: DataFrame, n: int, libs: Callable[[], Libraries]) -> dict[str, tuple[float, float]]:
    """Of a model of the records (record, path, content, held) that aren't held out, on those that are: (precision, recall) by kind."""
    model = fit(records.where("not held"), n, libs)
    if not model.weights.any():
        return {}  # no other repository
    shared = records.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shared.value), libs()
        for b in batches:
            said, labelled = [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                seen = look(path, text, known)
                said += (model.scores(*features(path, seen)) > 0).tolist()
                labelled += labels(seen, path).tolist()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(KINDS * b.num_rows, pa.string()), "said": pa.array(said, pa.bool_()), "labelled": pa.array(labelled, pa.bool_())})

    checked = spread(records.where("held")).dropDuplicates(["record"]).mapInArrow(run, "kind string, said boolean, labelled boolean")
    rows = checked.groupBy("kind").agg(F.count_if("said").alias("said"), F.count_if("labelled").alias("labelled"), F.count_if(F.col("said") & F.col("labelled")).alias("good")).collect()
    return {r["kind"]: (r["good"] / max(1, r["said"]), r["good"] / max(1, r["labelled"])) for r in rows}


def judged(files: DataFrame, tasks: DataFrame, libs: DataFrame) -> tuple[DataFrame, Model]:
    """(review_id, file_seq, kinds array<string>, origin) of the files that are not hand-written, and the model."""
    spark = files.sparkSession
    code = files.where(F.col("path").rlike(CODE) & (F.length(F.trim("content")) > 0)).select("review_id", "file_seq", "path", "content")
    repos = repos_of_reviews(tasks)
    known = spark.sparkContext.broadcast(Libraries.of(library_rows(libs)))
    records = code.withColumn("record", F.xxhash64("review_id", "file_seq", "path", "content")).withColumn("text", F.xxhash64("content"))
    n, lines = common_lines(spread(records.select("record", "text", "content")), lambda: known.value)
    common = spark.sparkContext.broadcast(lines)  # of a size fixed by the libraries

    def own_lines() -> Libraries:
        return replace(known.value, common=common.value)

    model = fit(records.select("record", "path", "content"), n, own_lines)

    def validate() -> dict[str, tuple[float, float]]:
        held = repos.withColumn("held", F.pandas_udf(fifth, "boolean")("repo")).select("review_id", "held")
        unknown = bool(fifth(pd.Series([""])).iloc[0])
        return held_out_scores(records.join(held, "review_id", "left").select("record", "path", "content", F.coalesce("held", F.lit(unknown)).alias("held")), n, own_lines)

    model.validate = validate
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # of a size fixed by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, libs = Model(*shared.value), own_lines()
        for b in batches:
            rows, kinds, origins = [], [], []
            for r, (path, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                found, origin = judge(path, text, model, libs)
                if found:
                    rows.append(r)
                    kinds.append(found)
                    origins.append(origin)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(kinds, pa.list_(pa.string())), pa.array(origins, pa.string())], names=["review_id", "file_seq", "kinds", "origin"])

    seq = dict(files.dtypes)["file_seq"]
    said = spread(code).mapInArrow(run, f"review_id string, file_seq {seq}, kinds array<string>, origin string").distinct()
    homed = said.join(repos, "review_id", "left")
    foreign = F.col("repo").isNull() | F.col("origin").isNull() | (F.col("origin") != F.col("repo"))
    own = F.when(foreign, F.col("kinds")).otherwise(F.array_remove("kinds", "library"))
    return homed.select("review_id", "file_seq", own.alias("kinds"), "origin").where(F.size("kinds") > 0), model


def not_handwritten(files: DataFrame, tasks: DataFrame, libs: DataFrame) -> DataFrame:
    """(review_id, file_seq, kinds, origin) of the files that nobody in their repository wrote by hand."""
    return judged(files, tasks, libs)[0]


def validation(files: DataFrame, tasks: DataFrame, libs: DataFrame) -> DataFrame:
    """(kind, held_out_precision, held_out_recall): of classifiers fitted without every fifth repository, on the files of those, against their labels."""
    model = judged(files, tasks, libs)[1]
    return files.sparkSession.createDataFrame([(k, *model.held_out.get(k, (None, None))) for k in KINDS], "kind string, held_out_precision double, held_out_recall double")
