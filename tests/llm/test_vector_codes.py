import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import vector_codes as V


def plain(rows):
    """(id, code, error, label error, hash) with Python integers, row by row."""
    kept = []
    for i, v, label in rows:
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i is None, i or 0, [int(c) * 4096 if abs(c) >= 2**52 else math.floor(c * 4096) for c in v], label))
    out = []
    for dim in {len(k[2]) for k in kept}:
        own = sorted((k for k in kept if len(k[2]) == dim), key=lambda k: k[:3])
        cut = np.cumsum([0, *(dim // 8 + (p < dim % 8) for p in range(8))]).tolist()
        parts = [[k[2][a:b] for k in own] for a, b in zip(cut, cut[1:])]
        books = [[list(v) for v in part[:16]] for part in parts]
        near = lambda p, v: min((sum((x - y) ** 2 for x, y in zip(v, c)), e) for e, c in enumerate(books[p]))
        for _ in range(6):
            for p in range(8):
                groups = {}
                for v in parts[p]:
                    groups.setdefault(near(p, v)[1], []).append(v)
                for e, g in groups.items():
                    books[p][e] = [sum(c) // len(g) for c in zip(*g)]
        sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for n, k in enumerate(own):
            found = [near(p, parts[p][n]) for p in range(8)]
            out.append((None if k[0] else k[1], "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), k[3], sha))
    total = Counter()
    for o in out:
        total[o[3]] += o[2]
    top = 2**63 - 1
    return [(i, code, min(error, top), min(sum(min(o[2], top) for o in out if o[3] == label), top), sha) for i, code, error, label, sha in out]


@pytest.mark.parametrize("block", [V.BLOCK, 37])
def test_equals_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist(), int(i % 3)) for i in rng.permutation(300).tolist()]
    rows += [(7, rows[0][1], None)] * 5 + [(None, rng.normal(size=24).tolist(), 1), (900, [0.0] * 24, None)]
    rows += [(901, None, 1), (902, [None] * 24, 1), (903, [math.nan] * 24, 1), (904, [math.inf] + [0.0] * 23, 1)]
    rows += [(910 + k, rng.normal(size=11).tolist(), 2) for k in range(20)] + [(950, [], 2)]
    frame = spark.createDataFrame([(i, v, x, "clash") for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string")
    got = [tuple(r) for r in V.compress(frame.repartition(3)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (3 * i % 40), 0.5 * i] * 8, "x") for i in range(40)]
    got = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_empty(spark):
    assert V.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
