import numpy as np

from tallyloom.llm import ann


def plain(rows, k=20, every=20):
    best = {}
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, v.tolist()), v.tolist())
    for q, v in asked.items():
        near = {}
        for i, x in fine:
            if i != q:
                s = 0.0
                for a, b in zip(x.tolist(), v):
                    s += a * b
                near[i] = max(near.get(i, -9e9), s)
        best[q] = [(i, near[i]) for i in sorted(near, key=lambda i: (-near[i], i))[:k]]
    return best


def table(n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(200)] + [(20, rows[20][1]), (40, rows[41][1])]
    return rows + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0] * 3), (None, hot)]


def test_exact_where_all_entries_are_reranked(spark):
    rows = table()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(df, block=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == plain(rows)


def test_recall_with_few_reranked(spark):
    rows = [(i, v) for i, v in table(3000, 2) if i is not None and i < 3000]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r.query_id, r.vec_id) for r in ann.search(df, block=1500, rerank=200).collect()}  # of both blocks together
    wanted = {(q, i) for q, near in plain(rows).items() for i, _ in near}
    assert len(found & wanted) >= 0.95 * len(wanted)


def test_nothing_is_missed_among_near_copies_and_mixed_lengths(spark):
    """A family larger than what is ranked exactly, whose members the codes cannot tell apart, and vectors a thousand times as long."""
    rng = np.random.default_rng(3)
    centre, rows = rng.normal(size=8), []
    for i in range(3000):
        v = centre + rng.normal(size=8) * 1e-6 if i % 3 else rng.normal(size=8) * 10.0 ** rng.integers(-2, 2)
        rows.append((i, [float(x) for x in v]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, block=1000, rerank=64).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == plain(rows)


def test_anisotropic_codes_lower_the_weighted_loss():
    x = np.random.default_rng(0).normal(size=(400, 8)).astype(np.float32)
    eta = 6.0
    books = ann.fit(x, eta)

    def loss(code):
        left = x - np.stack([books[m][code[:, m]] for m in range(4)], 1).reshape(len(x), 8)
        along = (left * x).sum(1) / np.linalg.norm(x, axis=1)
        return ((left**2).sum(1) + (eta - 1) * along**2).sum()

    assert loss(ann.encode(x, books, eta)) < loss(ann.encode(x, books, 1.0))


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
