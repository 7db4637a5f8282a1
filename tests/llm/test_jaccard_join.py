import random
import re
from collections import defaultdict

import pytest

from tallyloom.llm import jaccard_join as J


def plain(rows):
    """doc place -> (class id, links), by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near, group = defaultdict(set), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                near[i].add(j)
                near[j].add(i)
                x, y = group[i], group[j]
                group = [x if g == y else g for g in group]
    ids = defaultdict(list)
    for (i, _), g in zip(rows, group):
        if i is not None:
            ids[g].append(i)
    return [(i, min(ids[g], default=None), len(near[k])) for k, ((i, _), g) in enumerate(zip(rows, group))]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(150)]
    shared = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(330):  # more than a bucket holds: near copies of one text, most of them linked to one another
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(150)] = word()
        rows.append(" ".join(w))
    for _ in range(60):
        rows.append(shared + " " + " ".join(word() for _ in range(rng.randint(5, 90))))
    rows += [r.upper() for r in rows[:5]] + [rows[400 % len(rows)]] * 7
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [J.BLOCK, 100])
def test_equals_brute_force(spark, monkeypatch, block):
    """Leaves in one group, and in pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus() + [(900, None), (901, ""), (902, "one two"), (903, "One  two."), (904, "?!"), (None, "one two"), (905, "p " * 4000), (905, "p " * 4000), (906, "a b c d e")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = J.join(docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(plain(rows), key=key)
    kept = J.one_of_each(docs, broadcast_rows=0)
    assert kept.columns == docs.columns
    classes = {(c if c is not None else "none") for _, c, _ in plain(rows)}
    assert {r.doc_id for r in kept.collect()} == classes


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(docs).count() == 0 and J.one_of_each(docs).count() == 0
