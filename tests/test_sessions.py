import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import candidates, ledger, resolve, reviews, rules, splits
from tallyloom.operators import session as R
from tallyloom.operators import tiers as T
from tallyloom.operators.tolerance import Tolerance

LEFT = "session_id long, row_number long, value_date int, amount double, sign string, our_ref string, their_ref string, booking_text_1 string, booking_text_2 string"
RIGHT = "session_id long, row_number long, trn_ref string, value_date int, type string, narration string, amount double, ccy string, external_ref string, module string, user_id string, ac_branch string"
SESSIONS = "session_id long, account_id long, kind string, status string, locked_at timestamp, started_at timestamp, finished_at timestamp"
RULES = "rule_id int, priority int, require_tier int, require_amount_exact boolean, max_amount_diff double, require_ref_match boolean, require_same_date boolean"


def l(row, amount, ref="", day=20240105, sign="C", session=1, text=""):
    return (session, row, day, amount, sign, ref, "", text, "")


def r(row, amount, ref="", day=20240105, kind="DR", session=1, text=""):
    return (session, row, ref, day, kind, text, amount, "USD", "", "M", "u", "B")


def session(i, **kw):
    return (i, 10 + i, kw.get("kind", "two_sided"), kw.get("status", "open"), None, None, None)


def run(spark, left, right, sessions=None, **options):
    sessions = spark.createDataFrame(sessions or [session(1)], SESSIONS)
    return R.reconcile(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), sessions, **options)


def shown(got):
    return {(a.session_id, a.l_row, a.r_row, a.tier, a.status, a.source, a.decided_by) for a in got["assignments"].collect()}


def test_all_stages_of_a_run(spark):
    left = [l(1, 100.0, "REFAAA111"), l(2, 50.0, "REFBBB222"), l(3, 90.0, "SPLIT00333"), l(4, 70.0, "CARRY00777"), l(5, 12.0), l(6, 13.0), l(7, 999.0, "NOBODY0001")]
    right = [r(1, 100.0, "REFAAA111"), r(2, 58.0, "REFBBB222"), r(3, 40.0, "SPLIT"), r(4, 50.0, "SPLIT"), r(5, 5.5), r(6, 19.5), r(7, 1.0, day=20240301)]
    items = spark.createDataFrame([(900, 11, "ledger", "DR", 70.0, "CARRY00777", 20240101, "open"), (901, 11, "ledger", "DR", 70.0, "CARRY00778", 20240101, "cleared"), (902, 99, "ledger", "DR", 70.0, "CARRY00777", 20240101, "open")],
                                  "item_id long, account_id long, side string, sign string, amount double, ref string, value_date int, status string")
    rule = spark.createDataFrame([(5, 1, 2, None, 10.0, True, None), (4, 2, 2, None, None, None, None)], RULES)
    got = run(spark, left, right, items=items, auto_rules=rule, flags=R.Flags(carry_forward=True, splits=True, many_to_many=True))
    found = shown(got)
    assert (1, 1, 1, 1, "confirmed", "engine", "auto") in found
    assert (1, 2, 2, 2, "confirmed", "engine", "rule 5") in found
    assert (1, 4, 0, 0, "confirmed", "auto_carry", "auto") in found
    assert {(1, 3, 3, 5), (1, 3, 4, 5)} <= {x[:4] for x in found} and {(1, a, b, 6) for a in (5, 6) for b in (5, 6)} <= {x[:4] for x in found}
    assert len(found) == 9
    assert [a.item_id for a in got["assignments"].where("tier = 0").collect()] == [900]
    assert {(i.side, i.row_number) for i in got["items"].collect()} == {("statement", 7), ("ledger", 7)}
    entry = got["log"].collect()
    assert [(e.session_id, e.pairs, e.confirmed, e.split_rows, e.carried, e.by_rule, e.seeded) for e in entry] == [(1, 2, 3, 6, 1, 1, 2)]
    again = run(spark, left, right, existing=got["assignments"], flags=R.Flags(splits=True, many_to_many=True))
    assert again["assignments"].count() == 0 and again["items"].count() == 2


def test_flags_tiers_and_guards(spark):
    left = [l(1, 10.0, session=s) for s in (1, 2, 3, 4)] + [l(2, 10.4, "REFZZZ999", session=s) for s in (1, 2, 3, 4)]
    right = [r(1, 10.0, session=s) for s in (1, 2, 3, 4)] + [r(2, 10.0, "REFZZZ999", session=s, day=20240201) for s in (1, 2, 3, 4)]
    sessions = [session(1), session(2, kind="one_sided"), session(3, status="closed"), session(4)]
    settings = spark.createDataFrame([(14, 0.5, None, None, None, None)], "account_id long, amount_tol_abs double, amount_tol_pct double, date_tol_days int, min_ref_len int, fx_tol_bps double")
    own = {11: [T.of(8, "reference", ("sign", "mirror"), ("ref", "symmetric_in_narration"))]}
    got = run(spark, left, right, sessions, settings=settings, tiers=own, flags=R.Flags(seed=False))
    assert {x[:5] for x in shown(got)} == {(1, 2, 2, 8, "pending"), (2, 2, 2, 2, "pending"), (4, 1, 1, 3, "pending"), (4, 2, 2, 1, "confirmed")}
    assert [(x.session_id, x.refused) for x in got["refused"].collect()] == [(3, "closed")] and got["items"] is None


def test_greedy_equals_the_sequential_pass(spark):
    rng = random.Random(4)
    pairs = {(s, rng.randrange(30), rng.randrange(30)): (rng.randrange(1, 4), float(rng.randrange(3))) for s in (1, 2) for _ in range(150)}
    rows = [(*k, *v) for k, v in pairs.items()]
    want = set()
    for s in (1, 2):
        used_l, used_r = set(), set()
        for t, g, a, b in sorted((t, abs(g), a, b) for (x, a, b), (t, g) in pairs.items() if x == s):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                want.add((s, a, b))
    df = spark.createDataFrame(rows, "session_id long, l_row long, r_row long, tier int, amount_diff double")
    assert {(x.session_id, x.l_row, x.r_row) for x in resolve.greedy(df).collect()} == want


@pytest.mark.parametrize("tol", [Tolerance(), Tolerance(amount_pct=2.0), Tolerance(amount_abs=0.0)])
def test_first_subset_is_the_first_of_all_combinations(tol):
    rng = random.Random(9)
    for n in list(range(9)) * 20:
        amounts = [float(rng.choice((1, 2, 5, 10, 20, 33.3, -4, 0))) for _ in range(n)]
        target = float(rng.choice((sum(rng.sample(amounts, min(n, rng.randrange(5)))), 17.0, 1000.0)))
        want = next((list(p) for k in (2, 3, 4) for p in itertools.combinations(range(n), k) if splits._close(sum(amounts[i] for i in p), target, tol)), None)
        assert splits.first_subset(amounts, target, tol) == want
    assert splits.first_subset([1.0 + i / 977 for i in range(600)], -5.0, tol) is None  # a pool of six hundred rows


def test_many_to_many_runs_of_days_equal_whole_sessions(spark):
    days = [20240101, 20240102, 20240104, 20240120, 20240121]
    left = [(1, i, d, 10.0 + i, "C") for i, d in enumerate(days * 2)]
    right = [(1, i, d, 10.0 + i + (1 if i % 2 else -1), "DR") for i, d in enumerate(days * 2)]
    a = spark.createDataFrame(left, "session_id long, row_number long, value_date int, amount double, sign string")
    b = spark.createDataFrame(right, "session_id long, row_number long, value_date int, amount double, type string")
    got = splits.many_to_many(a, b).collect()
    ls, rs = [x for g in got for x in g.l_rows], [x for g in got for x in g.r_rows]
    assert got and len(ls) == len(set(ls)) and len(rs) == len(set(rs))
    amount = {i: x[3] for i, x in enumerate(left)}, {i: x[3] for i, x in enumerate(right)}
    for g in got:
        assert abs(sum(amount[1][x] for x in g.r_rows) - sum(amount[0][x] for x in g.l_rows)) <= 0.01
    early = {i for i, x in enumerate(left) if x[2] < 20240110}
    assert all(set(g.l_rows) <= early or not set(g.l_rows) & early for g in got)


def test_equal_pending_rows_stay_two(spark):
    rows = spark.createDataFrame([(1, 0.0, "A1", "A1", 1, 1)] * 2 + [(3, 9.0, "", "", 1, 2)], "tier int, amount_diff double, l_ref string, r_ref string, l_date int, r_date int")
    table = spark.createDataFrame([(2, 5, 1, True, None, None, None), (7, 1, 1, True, None, True, True)], RULES)
    assert sorted((x.tier, x.rule) for x in rules.auto_match(rows, table).collect() if x.rule) == [(1, 7), (1, 7)]
    assert rules.auto_match(rows, table).count() == 3 and rules.auto_match(rows, table.limit(0)).where("rule is null").count() == 3


def test_a_refused_file_leaves_the_anchor(spark):
    chain = [(1, 1, 0.0, 100.0, False), (1, 2, 999.0, 500.0, False), (1, 3, 100.0, 130.0, False), (1, 4, 7.0, 8.0, True), (1, 5, 8.004, 9.0, None)]
    got = ledger.continuity(spark.createDataFrame(chain, "account_id long, seq int, opening double, closing double, forced boolean"), forced="forced").orderBy("seq").collect()
    assert [(x.anchor, x.accepted) for x in got] == [(None, True), (100.0, False), (100.0, True), (130.0, True), (8.0, True)]


def test_carry_forward_by_percentage(spark):
    items = spark.createDataFrame([(1, 5, 1000.0, "C", "ITEM000001", 20240105), (2, 5, 50.0, "C", "ITEM000002", 20240105), (3, 6, 1000.0, "C", "ITEM000003", 20240105)], "item_id long, account_id long, amount double, sign string, ref string, value_date int")
    rows = spark.createDataFrame([(5, 11, 1009.0, "DR", [""], ["x"], 20240105), (5, 12, 50.6, "DR", [""], ["x"], 20240106), (6, 13, 1011.0, "DR", [""], ["x"], 20240105)],
                                 "account_id long, row_number long, amount double, sign string, own_refs array<string>, texts array<string>, value_date int")
    got = ledger.carry_forward(items, rows, Tolerance(amount_pct=1.0)).collect()
    assert {(x.item_id, x.row_number, x.phase) for x in got} == {(1, 11, 2)}


def test_decisions_anchors_and_certificates(spark):
    a = spark.createDataFrame([(1, 1, 2, "pending"), (2, 1, 1, "pending"), (3, 2, 1, "pending")], "key long, session_id long, tier int, status string")
    s = spark.createDataFrame([(1, "open", None), (2, "closed", None)], "session_id long, status string, locked_at timestamp")
    log = [(1, 1, "u", "bulk_confirm"), (1, 2, "u", "request_approval"), (1, 3, "u", "approve"), (1, 4, "v", "approve"), (1, 5, "w", "reject"), (2, 1, "u", "bulk_confirm"), (3, 1, "u", "confirm")]
    found = reviews.judged(a, spark.createDataFrame(log, "key long, at int, actor string, action string"), s)
    assert [(x.key, x.status, x.refused) for x in found.orderBy("key", "at").collect()] == [
        (1, "pending", "only tier 1 in bulk"), (1, "pending_approval", None), (1, "pending_approval", "own request"), (1, "confirmed", None), (1, "rejected", None), (2, "confirmed", None), (3, "pending", "session closed"),
    ]
    assert {(x.key, x.status, x.decided_by) for x in reviews.after(a, found).collect()} == {(1, "rejected", "w"), (2, "confirmed", "u"), (3, "pending", None)}
    figures = spark.createDataFrame([("open", "all", 3, 1.5), ("sessions", "all", 2, None)], "metric string, key string, n long, amount double")
    assert reviews.snapshot(figures).first().snapshot == '[{"metric":"open","key":"all","n":3,"amount":1.5},{"metric":"sessions","key":"all","n":2}]'


def test_open_items_of_a_session_are_seeded_once(spark):
    left, right = spark.createDataFrame([l(1, 5.0)], LEFT), spark.createDataFrame([r(1, 6.0)], RIGHT)
    none = spark.createDataFrame([], "session_id long, l_row long, r_row long")
    sessions = spark.createDataFrame([(1, "open")], "session_id long, status string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-09").cast("timestamp")
    after, items = ledger.close(sessions, now, 24, left, right, none, spark.createDataFrame([], "session_id long, side string, row_number long"))
    assert [x.status for x in after.collect()] == ["closed"] and items.count() == 2
    assert ledger.close(after, now, 24, left, right, none, items)[1].count() == 0


def _accounts(n):
    """One session for each account, of a tolerance of its own: a row a little within it and one a little beyond, without references."""
    sessions = [(i, 10 + i, "two_sided", "open", None, None, None) for i in range(n)]
    settings = [(10 + i, 0.5 + i / 100, None, None, None, None) for i in range(n)]
    left = [l(row, amount, session=i) for i in range(n) for row, amount in ((1, 1000.0), (2, 5000.0))]
    right = [r(row, amount, session=i) for i in range(n) for row, amount in ((1, 1000.49 + i / 100), (2, 5000.51 + i / 100))]
    return left, right, sessions, settings


def test_one_plan_serves_all_accounts(spark):
    """Five thousand accounts of different tolerances, some of different tiers, take as many jobs as two."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 5000):
        left, right, sessions, settings = _accounts(n)
        settings = spark.createDataFrame(settings, "account_id long, amount_tol_abs double, amount_tol_pct double, date_tol_days int, min_ref_len int, fx_tol_bps double")
        own = {11: T.default_tiers(), **({} if n < 9 else {17: [T.of(9, "exact", ("amount", "exact"), ("sign", "mirror"))]})}
        spark.sparkContext.setJobGroup(f"accounts {n}", "")
        got = run(spark, left, right, sessions, settings=settings, tiers=own, flags=R.Flags(seed=False))
        found = {(a.session_id, a.l_row, a.r_row, a.tier) for a in got["assignments"].collect()}
        assert found == {(i, 1, 1, 3) for i in range(n) if not (n > 9 and i == 7)}
        jobs.append(len(tracker.getJobIdsForGroup(f"accounts {n}")))
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 4  # adaptive execution may broadcast what is small, which is a job


def test_settings_and_tiers_of_rows_equal_those_of_a_run(spark):
    """Percentages, short references, rates and tiers on other fields: each session as if it ran alone."""
    rng = random.Random(12)
    texts, refs = ["", "wire FEE", "pays 7001234 now", "AB12"], ["", "AB12", "7001234", "X-900-77", "INV7001234"]
    left = [l(i, rng.choice([10.0, 10.2, 55.0, 1000.0]), rng.choice(refs), rng.choice([20240105, 20240106, 0]), rng.choice("CD"), s, rng.choice(texts)) for s in range(6) for i in range(25)]
    right = [r(i, rng.choice([10.0, 10.1, 55.5, 1004.0]), rng.choice(refs), rng.choice([20240105, 20240106, 0]), rng.choice(["DR", "CR"]), s, rng.choice(texts)) for s in range(6) for i in range(25)]
    tols = [Tolerance(), Tolerance(amount_abs=0.6), Tolerance(amount_pct=1.0), Tolerance(min_ref_len=4), Tolerance(amount_abs=0.25, amount_pct=0.5, min_ref_len=3), Tolerance()]
    own = [None, None, None, None, [T.of(1, "fee", ("amount", "equal_within_tol"), ("narration", "contains", {"text": "fee", "side": "left"})), T.of(2, "ref", ("ref", "in_other_narration"))],
           [T.of(7, "same", ("field", "equal", {"left": "our_ref", "right": "trn_ref"}), ("sign", "mirror")), T.of(3, "days", ("amount", "exact"), ("value_date", "within_days", {"n": 0}), priority=1)]]
    sessions = [session(s, kind="one_sided" if s == 3 else "two_sided") for s in range(6)]
    settings = spark.createDataFrame([(10 + s, t.amount_abs, t.amount_pct, None, t.min_ref_len, None) for s, t in enumerate(tols)], "account_id long, amount_tol_abs double, amount_tol_pct double, date_tol_days int, min_ref_len int, fx_tol_bps double")
    got = run(spark, left, right, sessions, settings=settings, tiers={10 + s: t for s, t in enumerate(own) if t}, flags=R.Flags(seed=False))
    found = {(a.session_id, a.l_row, a.r_row, a.tier) for a in got["assignments"].collect()}
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    want = set()
    for s in range(6):
        tiers = own[s] or T.default_tiers(two_sided=s != 3)
        alone = resolve.greedy(candidates.candidates(a.where(f"session_id = {s}"), b.where(f"session_id = {s}"), tiers, tols[s]))
        want |= {(x.session_id, x.l_row, x.r_row, x.tier) for x in alone.collect()}
    assert found == want and len(want) > 40
