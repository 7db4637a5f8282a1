"""Whole results where the code once did less: long chains, every order, every card number, open sessions, repeated splits."""

import random
from datetime import datetime
from itertools import combinations

from pyspark.sql import functions as F
from test_matching import left, right, sequential

from tallyloom.functions import pan
from tallyloom.operators import candidates as C
from tallyloom.operators import resolve as R
from tallyloom.operators import splits
from tallyloom.plans import catalog
from tallyloom.plans import derived as D
from tallyloom.plans import matching as M

SMALL = "/root/testdata/sf0.001"


def date_of(day):
    return datetime.strptime(str(day), "%Y%m%d")


def taken(df):
    return sorted((r.session_id, r.l_row, r.r_row) for r in df.collect())


def test_greedy_over_more_equal_rows_than_rounds(spark):
    """210 equal payments of each side, on the same day (settled by rank) and a day apart (one chain of 210 rounds)."""
    n = 210
    l = left(spark, *[dict(row=i) for i in range(n)])
    r = right(spark, *[dict(row=1000 + i) for i in range(n)])
    late = right(spark, *[dict(row=1000 + i, date=20240106) for i in range(n)])
    expected = [(1, i, 1000 + i) for i in range(n)]
    assert taken(R.greedy(C.candidates(l, r))) == expected
    assert C.equal_rows(l, r).count() == n and taken(R.assigned(l, r)) == expected
    assert taken(R.assigned(l, late)) == expected


def test_assigned_equals_the_sequential_pass(spark):
    """Equal rows among ones with references, near amounts and near dates."""
    rng = random.Random(2)
    row = lambda i: dict(row=i, amount=rng.choice([10.0, 10.0, 10.01, 20.0, 30.0]), date=rng.choice([20240105, 20240106, 20240107]))
    l = left(spark, *[row(i) | (dict(t1="pays INV700123 now") if i % 19 == 0 else dict(ref="INV700123") if i % 23 == 0 else {}) for i in range(70)])
    r = right(spark, *[row(i) | (dict(ref="INV700123", amount=20.0) if i % 17 == 0 else {}) for i in range(60)])
    l, r = (x.withColumn("session_id", F.col("row_number") % 2) for x in (l, r))
    pairs = C.candidates(l, r)
    assert C.equal_rows(l, r).count() > 0
    assert taken(R.assigned(l, r)) == sorted(sequential([(p.session_id, p.l_row, p.r_row, p.tier, p.amount_diff) for p in pairs.collect()]))


def test_colliding_queries_take_every_row(spark):
    l, r = M._colliding(spark, SMALL)
    assert (l.count(), r.count()) == (D.stmt(spark, SMALL).count(), D.ledg(spark, SMALL).count())
    lt, rt = ({(x.session_id, x.row_number): x for x in side.collect()} for side in (l, r))
    pairs = []
    for (s, i), a in lt.items():
        for (z, j), b in rt.items():
            if s == z and a.amount == b.amount and {"C": "DR", "D": "CR"}[a.sign] == b.type:
                days = abs((date_of(a.value_date) - date_of(b.value_date)).days)
                if days <= 1:
                    pairs.append((s, i, j, 3 + days, 0.0))
    won = sequential(pairs)
    assert taken(catalog.queries()["greedy_colliding"](spark, SMALL)) == sorted(won)
    rivals = catalog.queries()["competing_topk"](spark, SMALL).collect()
    assert {(x.session_id, x.l_row, x.r_row) for x in rivals} == {p[:3] for p in pairs} - set(won)  # no winner has more than six


def test_splits_carry_forward_and_rates_take_every_order(spark):
    q = lambda name: catalog.queries()[name](spark, SMALL)
    lines = D.table(spark, SMALL, "lineitem").groupBy("l_orderkey").count().where("count between 2 and 4")
    expected = {(x.l_orderkey % 8, x.l_orderkey, x["count"]) for x in lines.collect()}
    assert {tuple(x) for x in q("split_1n").collect()} == expected == {tuple(x) for x in q("split_n1").collect()}

    orders = D.table(spark, SMALL, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.date_trunc("month", "o_orderdate").alias("month")).collect()
    cleared = {(o.o_custkey % 5, o.o_orderkey, o.o_orderkey, 2 if o.o_orderkey % 3 == 0 else 1) for o in orders if o.o_orderkey % 5}
    assert {tuple(x) for x in q("carry_forward").collect()} == cleared

    months = {}
    for o in orders:
        months.setdefault(o.month, []).append(o.o_totalprice)
    rate = {o.o_orderkey: sum(months[o.month]) / len(months[o.month]) / 100000 for o in orders}
    got = {x.o_orderkey: x.rate for x in q("asof_fx").collect()}
    assert got.keys() == rate.keys() and all(abs(got[k] - rate[k]) < 1e-6 for k in rate)

    rows = catalog.queries()["m2n"](spark, SMALL.replace("0.001", "0.01")).collect()  # the smaller tables have none
    assert {x.l_row % 2 for x in rows} | {x.r_row % 2 for x in rows} == {0, 1}


def test_card_numbers_behind_other_numbers(spark):
    n, spaced, amex, long = "4111111111111111", "4111 1111-1111 1111", "378282246310005", "6304000000000000000"
    cases = [
        (f"order 12 {n}", {n}), (f"2024-01-05 {n}", {n}), (f"12 {spaced} 7", {spaced}), (f"{amex} 3", {amex}), (long, {long}),
        (f"9{n}9999", set()), ("4111111111111112", set()), (f"{n} {amex}", {n, amex}), (f"x{n}x", {n}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    rows = df.select("i", pan.pans(F.col("t")).alias("p"), pan.redact(F.col("t")).alias("r"), F.col("t").rlike(pan.CANDIDATE).alias("c")).collect()
    for r in rows:
        assert cases[r.i][1] <= set(r.p) and (bool(r.p) == bool(cases[r.i][1])), cases[r.i]
        assert not any(p in r.r for p in r.p) and (r.c or not r.p)
        assert r.p or r.r == cases[r.i][0]
    near = spark.createDataFrame([(f"{i:07} {n} {i:010}-{amex}",) for i in range(10**6, 10**6 + 300)], "t string").withColumn("r", pan.redact(F.col("t")))
    assert near.where((F.size(pan.pans(F.col("r"))) > 0) | (pan.redact(F.col("r")) != F.col("r")) | F.contains("r", F.lit(n))).count() == 0
    assert rows[0].r == "order 12 411111***1111" and rows[2].r == "12 411111***1111 7"


def test_luhn_mask_lists_every_length(spark, tmp_path):
    texts = ["pay 378282246310005", "on 2024-01-05 4111111111111111", "card 4111 1111 1111 1111"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.pan, r.masked) for r in catalog.queries()["luhn_mask"](spark, str(tmp_path)).collect()}
    assert got >= {(0, "378282246310005", "378282***0005"), (1, "4111111111111111", "411111***1111"), (2, "4111 1111 1111 1111", "411111***1111")}
    assert {r.left_over for r in catalog.queries()["pan_redact"](spark, str(tmp_path)).collect()} == {0}


def test_sessions_over_shuffled_files_equal_the_batch(spark, tmp_path):
    rows = D.table(spark, SMALL, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").toPandas().sort_values("ts")
    step = -(-len(rows) // 40)
    parts = [rows.iloc[i * step:(i + 1) * step] for i in range(40)]
    random.Random(1).shuffle(parts)
    for i, part in enumerate(parts):
        part.to_parquet(f"{tmp_path}/events-{i:02}.parquet", index=False, coerce_timestamps="us")
    batch = D.table(spark, SMALL, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    expected = sorted(tuple(r) for r in batch.select("user_id", "w.start", "w.end", "n").collect())
    assert sorted(tuple(r) for r in catalog.queries()["stream_session_window"](spark, str(tmp_path)).collect()) == expected


def test_equal_statement_rows_of_one_reference_both_split(spark):
    l = left(spark, dict(row=1, ref="SPLIT001"), dict(row=2, ref="SPLIT001"), dict(row=3, ref="SPLIT001"))
    r = right(spark, *[dict(row=10 + i, ref="SPLIT001", amount=50.0) for i in range(4)])
    assert sorted((s.l_rows, s.r_rows) for s in splits.one_to_many(l, r).collect()) == [([1], [10, 11]), ([2], [12, 13])]
    many = left(spark, *[dict(row=10 + i, ref="SPLIT001", amount=50.0) for i in range(4)])
    one = right(spark, dict(row=1, ref="SPLIT001"), dict(row=2, ref="SPLIT001"))
    assert sorted((s.l_rows, s.r_rows) for s in splits.many_to_one(many, one).collect()) == [([10, 11], [1]), ([12, 13], [2])]


def test_splits_equal_the_sequential_pass(spark):
    """References that contain one another, so that pools overlap without being equal."""
    rng = random.Random(3)
    ref = lambda: rng.choice(["", "AB", "ZZ"]) + rng.choice(["SPLIT001", "SPLIT002"]) + rng.choice(["", "77"])
    ls = [dict(row=i, ref=ref(), amount=float(rng.randint(3, 9))) for i in range(14)]
    rs = [dict(row=100 + i, ref=ref(), amount=float(rng.randint(1, 4))) for i in range(16)]
    used, expected = set(), []
    for a in ls:
        pool = [b for b in rs if (a["ref"] in b["ref"] or b["ref"] in a["ref"]) and b["row"] not in used]
        for p in (p for n in (2, 3, 4) for p in combinations(pool, n)):
            if sum(b["amount"] for b in p) == a["amount"]:
                expected.append(([a["row"]], [b["row"] for b in p]))
                used |= {b["row"] for b in p}
                break
    assert sorted((s.l_rows, s.r_rows) for s in splits.one_to_many(left(spark, *ls), right(spark, *rs)).collect()) == sorted(expected)


def test_hot_amounts_with_references_equal_the_sequential_pass(spark, monkeypatch):
    """Equal amounts of a few days with references that are equal, lie inside others, or stand alone, hot bins and cold ones."""
    monkeypatch.setattr(C, "HOT", 2)
    rng = random.Random(21)
    refs = [f"INV70{i:04d}" for i in range(40)]

    def row(i, at):
        ref = rng.choice(["", "", rng.choice(refs), rng.choice(refs)[3:] if at == "l" else "X" + rng.choice(refs), "7"])
        return dict(row=i, amount=rng.choice([10.0, 10.0, 10.0, 10.01, 20.0, 999.0 + i]), date=rng.choice([20240105, 20240106, 20240108]), ref=ref) | ({"t1" if at == "l" else "n": f"pays {rng.choice(refs)}"} if i % 7 == 0 else {})

    l, r = left(spark, *[row(i, "l") for i in range(120)]), right(spark, *[row(i, "r") for i in range(110)])
    pairs = C.candidates(l, r)
    got = R.assigned(l, r)
    want = sorted(sequential([(p.session_id, p.l_row, p.r_row, p.tier, p.amount_diff) for p in pairs.collect()]))
    assert taken(got) == want
    tier = {(p.l_row, p.r_row): (p.tier, p.auto_confirm, p.amount_diff, p.ref) for p in pairs.collect()}
    assert all(tier[x.l_row, x.r_row] == (x.tier, x.auto_confirm, x.amount_diff, x.ref) for x in got.collect())


def test_twenty_thousand_equal_amounts_of_a_day(spark):
    """With a reference on every row: of half of the rows it stands inside the other's, the rest is settled by amount and day."""
    n = 20000
    i = F.col("id")
    ref = F.concat(F.lit("PAY"), F.lpad(i.cast("string"), 8, "0"))
    rows = spark.range(n)
    none = F.lit("")
    l = rows.select(F.lit(1).alias("session_id"), i.alias("row_number"), F.lit(20240105).alias("value_date"), F.lit(100.0).alias("amount"), F.lit("C").alias("sign"), ref.alias("our_ref"), none.alias("their_ref"), none.alias("booking_text_1"), none.alias("booking_text_2"))
    other = F.when(i % 2 == 0, F.concat(F.lit("X"), ref)).otherwise(F.concat(F.lit("Z"), F.sha2(i.cast("string"), 256)))
    r = rows.select(F.lit(1).alias("session_id"), (n - i).alias("row_number"), F.lit(20240105).alias("value_date"), F.lit(100.0).alias("amount"), F.lit("DR").alias("type"), other.alias("trn_ref"), none.alias("external_ref"), none.alias("narration"))
    got = {x.l_row: (x.r_row, x.tier) for x in R.assigned(l, r).collect()}
    odd = [k for k in range(n) if k % 2]
    assert got == {k: (n - k, 1) for k in range(0, n, 2)} | {k: (m, 3) for k, m in zip(odd, sorted(n - k for k in odd))}
