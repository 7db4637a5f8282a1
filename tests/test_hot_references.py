"""Frequent references: sessions that hold one are resolved by blocks of alike rows, and agree with the sequential pass."""

import random

import pytest
import test_sessions as S
from pyspark.sql import functions as F
from test_matching import left, right, sequential
from test_whole import taken

from tallyloom.operators import candidates as C
from tallyloom.operators import resolve as R
from tallyloom.operators import tiers as T
from tallyloom.operators.tolerance import Tolerance


def drawn(spark, seed, n, sessions):
    """Rows of few references, amounts, days and texts: many are alike, some only nearly (a bar moves from one text to the next)."""
    rng = random.Random(seed)
    refs = ["INV700001", "inv-700001", "INV700002", "X9INV700001", "", "7"]

    def row(i, at):
        texts = {"t1": rng.choice(["", "", "pays INV700002", "a|b"]), "t2": rng.choice(["", "|b"])} if at == "l" else {"n": rng.choice(["", "", "for INV700001 thanks", "INV700002|x"]), "ext": rng.choice(["", "", "INV700002"])}
        return dict(row=i, amount=rng.choice([10.0, 10.0, 10.004, 12.5, 700.0]), date=rng.choice([20240105, 20240106, 20240120]), ref=rng.choice(refs)) | texts | ({"sign": rng.choice("CCD")} if at == "l" else {"type": rng.choice(["DR", "DR", "CR"])})

    session = F.col("row_number") % sessions
    return left(spark, *[row(i, "l") for i in range(n)]).withColumn("session_id", session), right(spark, *[row(i, "r") for i in range(n - 7)]).withColumn("session_id", session)


@pytest.mark.parametrize("hot, two_sided, sessions", [(0, True, 1), (0, False, 2), (3, True, 6)])
def test_blocks_of_references_equal_the_sequential_pass(spark, monkeypatch, hot, two_sided, sessions):
    monkeypatch.setattr(C, "HOT", hot)
    tiers, tol = T.default_tiers(two_sided), Tolerance(amount_abs=0.01)
    l, r = drawn(spark, 5 + hot, 130, sessions)
    if hot:  # one session without any reference is never hot
        plain = F.col("session_id") == 0
        l, r = l.withColumn("our_ref", F.when(plain, "").otherwise(F.col("our_ref"))), r.withColumn("trn_ref", F.when(plain, "").otherwise(F.col("trn_ref")))
    pairs = C.candidates(l, r, tiers, tol).collect()
    got = R.assigned(l, r, tiers, tol)
    assert taken(got) == sorted(sequential([(p.session_id, p.l_row, p.r_row, p.tier, p.amount_diff) for p in pairs]))
    tier = {(p.session_id, p.l_row, p.r_row): (p.tier, p.auto_confirm, p.amount_diff, p.ref) for p in pairs}
    assert all(tier[x.session_id, x.l_row, x.r_row] == (x.tier, x.auto_confirm, x.amount_diff, x.ref) for x in got.collect())


def test_twenty_thousand_rows_of_one_reference(spark):
    """Over many days; every tenth amount differs, so that it is matched by its reference alone."""
    n, i, none = 20000, F.col("id"), F.lit("")
    amount = lambda at: F.when(i % 10 == 0, at).otherwise(100.0)
    day = (20240101 + i % 28).cast("int")
    rows = spark.range(n)
    l = rows.select(F.lit(1).alias("session_id"), i.alias("row_number"), day.alias("value_date"), amount(F.lit(50.0)).alias("amount"), F.lit("C").alias("sign"), F.lit("SO4711000").alias("our_ref"), F.lit(None).alias("their_ref"), F.lit("rent").alias("booking_text_1"), F.lit(None).alias("booking_text_2"))
    r = rows.select(F.lit(1).alias("session_id"), (i + n).alias("row_number"), day.alias("value_date"), amount(F.lit(51.0)).alias("amount"), F.lit("DR").alias("type"), F.lit("SO4711000").alias("trn_ref"), none.alias("external_ref"), none.alias("narration"))
    got = {x.l_row: (x.r_row, x.tier, x.amount_diff) for x in R.assigned(l, r).collect()}
    assert got == {k: (k + n, 2, 1.0) if k % 10 == 0 else (k + n, 1, 0.0) for k in range(n)}


def test_sides_without_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 0)
    l, r = drawn(spark, 1, 20, 1)
    assert R.assigned(l.limit(0), r).count() == 0 and R.assigned(l, r.limit(0)).count() == 0


def test_runs_with_settings_of_accounts_take_the_same_pairs(spark, monkeypatch):
    """Rows that carry their tiers and tolerances: a session's blocks agree in these, as all of them are its account's."""
    rng = random.Random(9)
    refs = ["SO4711000", "SO4711001", ""]
    lefts = [S.l(i, rng.choice([10.0, 10.0, 11.0]), rng.choice(refs), session=i % 2, text=rng.choice(["", "pays SO4711001"])) for i in range(80)]
    rights = [S.r(i, rng.choice([10.0, 10.0, 10.4]), rng.choice(refs), session=i % 2) for i in range(70)]
    settings = spark.createDataFrame([(10, 0.0, 0.0, 1, 4, 0.0), (11, 0.5, 0.0, 1, 4, 0.0)], "account_id long, amount_tol_abs double, amount_tol_pct double, date_tol_days int, min_ref_len int, fx_tol_bps double")
    found = []
    for hot in (0, 10**9):
        monkeypatch.setattr(C, "HOT", hot)
        found.append(S.shown(S.run(spark, lefts, rights, [S.session(0), S.session(1)], settings=settings)))
    assert found[0] == found[1] and {a[3] for a in found[0]} >= {1, 2, 3}
