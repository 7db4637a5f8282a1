"""Tiers, candidates, resolution and splits against hand-made cases and sequential passes."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import candidates as C
from tallyloom.operators import resolve as R
from tallyloom.operators import splits, tiers
from tallyloom.operators.tolerance import Tolerance

L = "session_id long, row_number long, value_date int, amount double, sign string, our_ref string, their_ref string, booking_text_1 string, booking_text_2 string"
G = "session_id long, row_number long, value_date int, amount double, type string, trn_ref string, external_ref string, narration string"


def left(spark, *rows):
    return spark.createDataFrame([(1, r.get("row", 1), r.get("date", 20240105), r.get("amount", 100.0), r.get("sign", "C"), r.get("ref", ""), "", r.get("t1", ""), r.get("t2", "")) for r in rows], L)


def right(spark, *rows):
    return spark.createDataFrame([(1, r.get("row", 1), r.get("date", 20240105), r.get("amount", 100.0), r.get("type", "DR"), r.get("ref", ""), r.get("ext", ""), r.get("n", "")) for r in rows], G)


def test_tier_cases(spark):
    """Sessions keep the cases apart."""
    cases = [
        (1, dict(ref="INV-00123"), dict(ref="INV 00123"), 1), (2, dict(ref="INV00123"), dict(ref="INV00123", amount=75.0), 2), (3, {}, {}, 3), (4, {}, dict(date=20240106), 4),
        (5, dict(ref="INV00123"), dict(ref="INV00123", type="CR"), None), (6, {}, dict(date=20240108), None), (7, dict(ref="7"), dict(ref="7", amount=50.0), None),
        (8, dict(t1="paid 20240105991 ok"), dict(ref="20240105991", amount=100.0, date=20240301), 1), (9, dict(t1="wire transfer abc", amount=5.0), dict(n="wire transfer abc", amount=9.0), None),
        (10, dict(date=0), dict(date=0), None), (11, dict(sign="X"), {}, None), (12, dict(amount=100.0), dict(amount=100.02), None),
    ]
    l = left(spark, *[dict(a, row=s) for s, a, _, _ in cases]).withColumn("session_id", F.col("row_number"))
    r = right(spark, *[dict(b, row=s) for s, _, b, _ in cases]).withColumn("session_id", F.col("row_number"))
    got = {x.session_id: (x.tier, x.auto_confirm) for x in C.candidates(l, r).collect()}
    assert got == {s: (t, t == 1) for s, _, _, t in cases if t}


def test_unknown_condition_never_holds_and_json(spark):
    t = tiers.from_json(9, "x", '[{"field": "amount", "op": "exact"}, {"field": "nope", "op": "nope"}]')
    assert C.candidates(left(spark, {}), right(spark, {}), [t]).count() == 0
    t = tiers.from_json(9, "x", '[{"field": "field", "op": "equal", "params": {"left": "our_ref", "right": "trn_ref"}}, {"field": "narration", "op": "contains", "params": {"text": "fee", "side": "right"}}]')
    assert C.candidates(left(spark, dict(ref="A")), right(spark, dict(ref="A", n="Fee")), [t]).first().tier == 9


def test_normalize(spark):
    rows = spark.createDataFrame([("00ab-1/2",), (None,), ("000",), (" [x]'y\"",)], "c string")
    assert [r.n for r in rows.select(text.normalize_ref(F.col("c")).alias("n")).collect()] == ["AB12", "", "0", "XY"]


def sequential(pairs):
    used_l, used_r, out = set(), set(), []
    for s, l, r, t, d in sorted(pairs, key=lambda p: (p[0], p[3], abs(p[4]), p[1], p[2])):
        if (s, l) not in used_l and (s, r) not in used_r:
            used_l.add((s, l))
            used_r.add((s, r))
            out.append((s, l, r))
    return out


def test_greedy_equals_the_sequential_pass(spark):
    rng = random.Random(4)
    pairs = {(s, rng.randrange(12), rng.randrange(12)): (rng.randint(1, 4), rng.choice([0.0, 0.5, -0.5, 1.0])) for s in range(12) for _ in range(40)}
    rows = [(*k, *v) for k, v in pairs.items()]
    df = spark.createDataFrame(rows, "session_id long, l_row long, r_row long, tier int, amount_diff double")
    won = R.greedy(df)
    assert sorted((r.session_id, r.l_row, r.r_row) for r in won.collect()) == sorted(sequential(rows))
    lost = R.competing(df, won).collect()
    assert len(lost) == len(rows) - len(sequential(rows)) and all(r.winner_l == r.l_row or r.winner_r == r.r_row for r in lost)
    assert max(r.place for r in R.top_competing(R.competing(df, won), 3).collect()) <= 3


@pytest.mark.parametrize("tol", [Tolerance(), Tolerance(amount_abs=7.0), Tolerance(amount_abs=0.5, amount_pct=1.5)])
def test_range_join_equals_brute_force(spark, tol):
    rng = random.Random(9)
    a = [round(rng.choice([1, 50, 400]) * rng.random() * 10, 2) for _ in range(150)]
    b = [round(x + rng.choice([0, 0.01, -0.01, 3, 7, -7]), 2) for x in a]
    l, r = left(spark, *[dict(row=i, amount=x) for i, x in enumerate(a)]), right(spark, *[dict(row=i, amount=x) for i, x in enumerate(b)])
    got = [(x.l_row, x.r_row) for x in C.amount_window_join(l, r, tol).collect()]
    width = lambda x: max(tol.amount_abs, abs(x) * tol.amount_pct / 100) + 1e-9
    assert sorted(got) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(y - x) <= width(x))


def test_splits(spark):
    l = left(spark, dict(row=1, ref="SPLIT001", amount=60.0), dict(row=2, ref="OTHER999", amount=5.0))
    r = right(spark, *[dict(row=10 + i, ref="SPLIT001", amount=x) for i, x in enumerate((10.0, 20.0, 30.0, 45.0))])
    (s,) = splits.one_to_many(l, r).collect()
    assert (s.l_rows, s.r_rows, s.tier, s.amount_diff) == ([1], [10, 11, 12], 5, 0.0)
    parts = splits.persisted(splits.one_to_many(l, r)).collect()
    assert len(parts) == 3 and len({p.split_group_id for p in parts}) == 1 and len(parts[0].split_group_id) == 12
    (m,) = splits.many_to_one(left(spark, dict(row=1, ref="XX-SPLIT01", amount=7.0), dict(row=2, ref="SPLIT01", amount=8.0)), right(spark, dict(row=5, ref="SPLIT01", amount=15.0))).collect()
    assert (m.l_rows, m.r_rows) == ([1, 2], [5])


def test_many_to_many(spark):
    l = left(spark, dict(row=1, amount=10.0), dict(row=2, amount=20.0), dict(row=3, amount=77.0, date=20240301))
    r = right(spark, dict(row=5, amount=12.0), dict(row=6, amount=18.0), dict(row=7, amount=500.0))
    (s,) = splits.many_to_many(l, r).collect()
    assert (s.l_rows, s.r_rows, s.tier) == ([1, 2], [5, 6], 6)
    assert splits.many_to_many(l, r.withColumn("amount", F.col("amount") + 1)).count() == 0
    many = right(spark, *[dict(row=i, amount=15.0) for i in range(21)])
    assert splits.many_to_many(l, many).count() == 0
    three = splits.many_to_many(left(spark, *[dict(row=i, amount=float(i)) for i in range(6)]), right(spark, *[dict(row=i, amount=float(i)) for i in range(6)])).collect()
    used = [("l", x) for s in three for x in s.l_rows] + [("r", x) for s in three for x in s.r_rows]
    assert len(used) == len(set(used)) and combinations
