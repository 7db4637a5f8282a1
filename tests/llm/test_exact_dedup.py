from collections import defaultdict
from hashlib import sha256

import pytest

from tallyloom.llm import exact_dedup

ROWS = [(1, "a", 9), (2, "a", 9), (3, "A", 9), (None, "a", 9), (4, None, 9), (5, "", 9), (6, "x" * 50_000, 9), (7, "x" * 50_000, 9), (7, "x" * 50_000, 8), (None, "n", 1), (None, "n", 1)] + [
    (100 + i, f"t{i % 40}", i) for i in range(200)
]
SCHEMA = "doc_id long, text string, keep_id int"


def plain(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), i == top, sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"key_bits": 3, "capacity": 4}, {"capacity": 2, "broadcast_keys": 0}, {"key_bits": 4, "capacity": 1, "hot": 2}])
def test_equals_brute_force(spark, options):
    """Few key bits make different texts share keys, which then are chained."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.dedup(docs, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == plain(ROWS)
    if options.get("key_bits"):
        assert max(r.chain for r in got) > 1


@pytest.mark.parametrize("key_bits", [64, 24])
def test_buckets_split_until_none_is_overfull(spark, key_bits):
    """Keys that share their first 30 (or 15) bits, beyond any fixed depth; every key lies in exactly one bucket, buckets in whole ranges."""
    shared = key_bits // 2 - 2
    keys = [(i << (key_bits - shared - 10)) + 5 for i in range(1000)] + [(1 << (key_bits - 2)) + i * 7919 for i in range(50)]
    held, owners = exact_dedup.index(spark.createDataFrame([(k, 1) for k in keys], "key long, n long"), capacity=8, key_bits=key_bits)
    rows = held.collect()
    assert sorted(r.key for r in rows) == sorted(keys) and owners > 100
    buckets = defaultdict(list)
    for r in rows:
        buckets[r.bucket].append(r.key)
    assert max(map(len, buckets.values())) <= 8
    spans = sorted((min(b), max(b)) for b in buckets.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(first <= min(b) for first, b in buckets.items())


def test_survivors_are_one_row_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.survivors(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.text or "") for r in rows) == sorted({t or "" for _, t, _ in ROWS})
    best = {t or "": k for _, k, _, _, t in []} or {(t or ""): max((i for i, u, _ in ROWS if (u or "") == (t or "") and i is not None), default=None) for _, t, _ in ROWS}
    assert all(r.doc_id == best[r.text or ""] for r in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.dedup(docs).count() == 0 and exact_dedup.survivors(docs).count() == 0
