from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing


def plain_targets(size_of: dict) -> dict:
    """Shares by weight, cut at three times the source's size, the excess shared again until none is above."""
    names = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    cap = {s: 3 * size_of[s] for s in names}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(size_of.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(target[s] - cap[s] for s in open_ if target[s] > cap[s])
        over = {s for s in open_ if target[s] >= cap[s]}
        for s in over:
            target[s] = float(cap[s])
        open_ -= over
    return target


ROWS = (
    [(i, "w " * (1 + i % 7), "a") for i in range(300)]
    + [(1000 + i, "x y z " * (1 + i % 5), "b") for i in range(40)]
    + [(2000 + i, "q " * 3, None) for i in range(5)]
    + [(3000, None, "c"), (3001, "", "c"), (None, "one two", "d"), (None, "one two", "d"), (3002, "k" * 50, "é")]
)
SCHEMA = "doc_id long, text string, source string"


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("copies", F.lit("clash")).withColumn("h", F.lit(1))
    rows = mixing.mix(docs).collect()
    size_of = defaultdict(int)
    for _, text, source in ROWS:
        size_of[source] += len((text or "").split())
    expected = plain_targets(size_of)
    assert len(rows) == len(ROWS)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in size_of:
        assert abs(taken[s] - expected[s]) <= longest[s]
    assert sum(expected.values()) == pytest.approx(sum(size_of.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_rows_are_repeated_as_often_as_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("mix_bound", F.lit(7))
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: n for k, n in copies.items() if n}


def test_rows_without_words_and_rows_that_share_a_hash(spark):
    """Never more than three copies; half of a source are equal rows without id, which are split at the boundary."""
    rows = [(i, None if i % 2 else "", "a") for i in range(50)] + [(100 + i, "w " * 9, "a") for i in range(10)]
    rows += [(None, "one two three", "b")] * 200 + [(1000 + i, "four", "b") for i in range(20)] + [(5000 + i, "x " * 40 + "y" * 9000, "c") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, size_of = mixing.mix(docs).collect(), defaultdict(int)
    for _, text, source in rows:
        size_of[source] += len((text or "").split())
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= mixing.MAX_EPOCHS
        taken[r.source] += r.taken
    longest = {"a": 9, "b": 3, "c": 41}
    for s, want in plain_targets(size_of).items():
        assert abs(taken[s] - want) <= longest[s]
    out = mixing.mixed(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((r.doc_id or 0, t or "") for r, t in _copied(got, rows))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))


def _copied(got, rows):
    text_of = {i: t for i, t, _ in rows}
    return [(r, text_of[r.doc_id]) for r in got for _ in range(r.copies)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
