import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import minhash as M


def shingle_set(text):
    w = re.findall("[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """(id, set size, component, kept), by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    root, by_shingle = list(range(len(rows))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by_shingle[x]}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
        for x in s:
            by_shingle[x].append(i)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)].append(i)
    low = [min(ids[top(k)], default=None) for k in range(len(rows))]
    return [(i, len(sets[k]), low[k], i == low[k]) for k, (i, _) in enumerate(rows)]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(150)]
    shared = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(300):  # near copies of one text, most of them linked to one another
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 7])):
            w[rng.randrange(150)] = word()
        rows.append(" ".join(w))
    for _ in range(80):
        rows.append(shared + " " + " ".join(word() for _ in range(rng.randint(2, 90))))
    rows += [" ".join(base[: rng.randrange(3, 150)]) for _ in range(60)]
    rows += [r.upper() for r in rows[:5]] + [rows[400 % len(rows)]] * 7
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGES = [(900, None), (901, ""), (902, "one two"), (903, "One  two\n"), (904, "?!"), (None, "one two"), (905, "p " * 4000), (905, "p " * 4000), (906, "a b c d e"), (907, " \t "), (None, None)]


@pytest.mark.parametrize("block", [M.BLOCK, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    """Lists in one group, and in pairs of blocks with hubs of several groups."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "AT_HUB", 4096 if block == M.BLOCK else 30)
    rows = corpus() + EDGES
    got = M.dedup(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain(rows), key=key)


def test_pairs_at_the_threshold(spark):
    """Two thousand pairs of a similarity of 0.80 to 0.86, long and short, and as many just below: none is lost, none invented."""
    rng = random.Random(8)
    rows = []
    for k in range(4000):
        n = rng.randrange(40, 300)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        wanted = rng.uniform(0.8, 0.86) if k % 2 else rng.uniform(0.72, 0.8)
        cut = round((n - 3) * wanted) + 3  # the second is the first one's beginning
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut]))]
    got = {r.doc_id: r.component_id for r in M.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r[2] for r in plain(rows)}
    assert got == want and sum(want[2 * k + 1] == 2 * k for k in range(4000)) > 1800


def test_estimate_of_small_sets_is_exact():
    a, b = np.arange(100, dtype="<u4"), np.arange(20, 110, dtype="<u4")
    got = M.estimate(M._sketches([a.tobytes()]), M._sketches([b.tobytes()]))
    assert got[0] == len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_empty(spark):
    assert M.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
