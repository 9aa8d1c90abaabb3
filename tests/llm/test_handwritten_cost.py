"""The columns and values of a text by their definition, and at a cost near a plain count's."""

import random
from time import process_time

import numpy as np

from auditlake.llm import handwritten as H
from tests.llm.test_handwritten import data, hand, made, small


def plain(body):
    """Columns and values of the n-grams, counted over all columns."""
    w = np.frombuffer(body.encode().translate(H.DIGITS), np.uint8).astype(np.uint32)
    if len(w) < 6:
        return np.empty(0, np.intp), np.empty(0, np.float32)
    four = w[:-3] | (w[1:-2] << np.uint32(8)) | (w[2:-1] << np.uint32(16)) | (w[3:] << np.uint32(24))
    six = four[:-2] ^ ((four[2:] >> np.uint32(16)) * np.uint32(0x85EBCA6B))
    both = np.concatenate([(four * np.uint32(0x9E3779B1)) >> np.uint32(19), np.uint32(H.DIMS // 2) + ((six * np.uint32(0xC2B2AE35)) >> np.uint32(19))])
    n = np.bincount(both.astype(np.intp), minlength=H.DIMS)
    columns = np.flatnonzero(n)
    return columns, np.sqrt(n[columns] / len(both)).astype(np.float32)


def test_features():
    rng = random.Random(4)
    for body in ["", "abcde", "abcdef", "é" * 7, "x" * 70000, "1,23" * 900, *(f(rng) for f in (hand, made, small, data) for _ in range(9))]:
        seen = H.look("lib\\app//one_two.min.js", body, H.Libraries())
        columns, values = H.features("lib\\app//one_two.min.js", seen)
        grams, shares = plain(body)
        of_path = sorted({H.path_column(x) for x in ("/lib", "/app", ".min.js", "_min", "_js")})
        assert columns.tolist() == grams.tolist() + of_path + [H.DIMS + H.PATH_DIMS + x for x in seen.shape]
        assert values.tolist() == shares.tolist() + [0.25] * len(of_path) + [np.float32(0.35)] * len(seen.shape)


def test_cost():
    rng = random.Random(6)
    bodies = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ()_\n", k=20000)) for _ in range(10)]
    seen = [H.look("a.py", x, H.Libraries()) for x in bodies]

    def least(run):
        took = []
        for _ in range(9):
            began = process_time()
            run()
            took.append(process_time() - began)
        return min(took)

    assert least(lambda: [H.features("a.py", x) for x in seen]) < 2 * least(lambda: [plain(x) for x in bodies])
