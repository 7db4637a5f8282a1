"""Queries over matching: predicates, candidates, tiers, resolution, splits, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import candidates as C
from tallyloom.operators import resolve as R
from tallyloom.operators import tiers as T
from tallyloom.operators import tolerance as tol
from tallyloom.plans import derived as D

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


def _sides(spark, d):
    return D.stmt(spark, d), D.ledg(spark, d)


def _shown(df):
    return df.select("session_id", "l_row", "r_row", "tier", F.round("amount_diff", 4).alias("amount_diff"))


_CAND = "SELECT session_id, l_row, r_row, CAST(tier AS INTEGER) AS tier, round(amount_diff, 4) AS amount_diff FROM {}"


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, abs(round(l_extendedprice, 1) - l_extendedprice) <= 0.01 AS ok FROM lineitem")
def filter_amount_tol(spark, d):
    a = F.col("l_extendedprice")
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a, tol.amount_ok(a, F.round(a, 1)).alias("ok"))


@query("""SELECT o_orderkey, abs(o_totalprice - floor(o_totalprice / 500) * 500) <= 0.01
       OR abs(o_totalprice - floor(o_totalprice / 500) * 500) / greatest(abs(o_totalprice), abs(floor(o_totalprice / 500) * 500), 1.0) * 100 <= 0.2 AS ok FROM orders""")
def filter_amount_pct(spark, d):
    a = F.col("o_totalprice")
    return D.table(spark, d, "orders").select("o_orderkey", tol.amount_ok(a, F.floor(a / 500) * F.lit(500.0), tol.Tolerance(amount_pct=0.2)).alias("ok"))


_RAW = "concat('0', CAST(o_orderkey AS VARCHAR), '-ab/', o_orderpriority, ' [', CAST(o_custkey AS VARCHAR), ']')"
_NORM = "upper(translate({}, ' \t/\\-_.,;:|()[]{{}}''\"', ''))"


@query(f"""WITH t AS (SELECT o_orderkey, {_NORM.format(_RAW)} AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <> '' AND ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END AS ref FROM t""")
def normalize_ref(spark, d):
    raw = F.concat(F.lit("0"), F.col("o_orderkey"), F.lit("-ab/"), F.col("o_orderpriority"), F.lit(" ["), F.col("o_custkey"), F.lit("]"))
    return D.table(spark, d, "orders").select("o_orderkey", text.normalize_ref(raw).alias("ref"))


@query(r"""WITH t AS (SELECT event_id, unnest(regexp_split_to_array(concat_ws(' ', event_type, 'INV-', CAST(event_id * 7919 AS VARCHAR), props), '[\s/\\\-_.,;:|()\[\]{}''"]+')) AS t FROM events),
n AS (SELECT DISTINCT event_id, CASE WHEN t <> '' AND ltrim(upper(t), '0') = '' THEN '0' ELSE ltrim(upper(t), '0') END AS token FROM t WHERE t <> '')
SELECT event_id, token FROM n WHERE length(token) >= 3 AND length(regexp_replace(token, '[^0-9]', '', 'g')) >= greatest(2.0, 0.4 * length(token))""")
def ref_like_tokens(spark, d):
    words = F.concat_ws(" ", F.col("event_type"), F.lit("INV-"), (F.col("event_id") * 7919).cast("string"), F.col("props"))
    return D.table(spark, d, "events").select("event_id", F.explode(text.ref_tokens(words, min_len=3)).alias("token"))


@query("WITH " + D.PAIRS + " SELECT session_id, l_row, r_row FROM pairs WHERE ref_ok")
def ref_token_join(spark, d):
    return C.ref_token_join(*_sides(spark, d))


@query("WITH " + D.STMT + "," + D.LEDG + """ SELECT l.session_id, l.row_number AS l_row, r.row_number AS r_row FROM stmt l JOIN ledg r ON l.session_id = r.session_id
 AND r.type = CASE l.sign WHEN 'C' THEN 'DR' ELSE 'CR' END AND abs(r.amount - l.amount) <= 25.0 + 1e-9""")
def amount_range_join(spark, d):
    return C.amount_window_join(*_sides(spark, d), tol.Tolerance(amount_abs=25.0))


def _tier(name, number):
    def run(spark, d):
        return _shown(C.at_tier(*_sides(spark, d), number))

    Q[name], O[name] = run, "WITH " + D.PAIRS + " " + _CAND.format("cand") + f" WHERE tier = {number}"


for _n, _name in enumerate(("t1_strict", "t2_ref_only", "t3_same_day", "t4_one_day"), 1):
    _tier(_name, _n)


@query("WITH " + D.PAIRS + " " + _CAND.format("cand") + " WHERE tier IS NOT NULL")
def tier_first_match(spark, d):
    return _shown(C.candidates(*_sides(spark, d)))


_WON = D.PAIRS + """,
cut AS (SELECT * FROM cand WHERE tier IS NOT NULL)"""


@query("WITH " + _WON + " " + _CAND.format("cut") + " WHERE l_row = r_row")
def greedy_resolve(spark, d):
    return _shown(R.assigned(*_sides(spark, d)))


@query("WITH " + _WON + " SELECT session_id, row_number FROM stmt WHERE row_number NOT IN (SELECT l_row FROM cut WHERE l_row = r_row)")
def unmatched_left(spark, d):
    l, r = _sides(spark, d)
    return R.unmatched(l, R.assigned(l, r), "l").select("session_id", "row_number")


@query("WITH " + _WON + " SELECT session_id, row_number FROM ledg WHERE row_number NOT IN (SELECT r_row FROM cut WHERE l_row = r_row)")
def unmatched_right(spark, d):
    l, r = _sides(spark, d)
    return R.unmatched(r, R.assigned(l, r), "r").select("session_id", "row_number")


def _colliding(spark, d):
    """Both sides with amounts rounded to thousands and no references: many candidates for every row."""
    l, r = _sides(spark, d)
    rounded = F.round(F.col("amount"), -3)
    return l.withColumn("amount", rounded).withColumn("our_ref", F.lit("")), r.withColumn("amount", rounded).withColumn("trn_ref", F.lit(""))


@query()
def greedy_colliding(spark, d):
    """Order-dependent, so beyond plain SQL; tests compare with a sequential pass."""
    return _shown(R.assigned(*_colliding(spark, d), tol=tol.Tolerance(amount_abs=0.01)))


@query()
def competing_topk(spark, d):
    return R.top_rivals(*_colliding(spark, d)).select("session_id", "winner_l", "winner_r", "place", "l_row", "r_row", "tier")


@query("WITH " + D.PAIRS + """ SELECT CAST(tier AS INTEGER) AS tier, count(*) AS pairs, count(DISTINCT l_row) AS l_rows,
  round(100.0 * count(DISTINCT l_row) / (SELECT count(*) FROM stmt), 1) AS rate FROM cand WHERE tier IS NOT NULL GROUP BY 1""")
def match_preview(spark, d):
    l, r = _sides(spark, d)
    total = l.agg(F.count("*").alias("n"))
    found = C.candidates(l, r).groupBy("tier").agg(F.count("*").alias("pairs"), F.countDistinct("l_row").alias("l_rows"))
    return found.crossJoin(F.broadcast(total)).select("tier", "pairs", "l_rows", F.round(100.0 * F.col("l_rows") / F.col("n"), 1).alias("rate"))


@query("WITH " + D.PAIRS + """, cond AS (SELECT l_row, amount_ok, ref_ok, same_day FROM pairs)
SELECT count(*) AS pairs, count(*) FILTER (WHERE amount_ok AND ref_ok) AS accepted, count(*) FILTER (WHERE amount_ok) AS amount_hits, count(*) FILTER (WHERE ref_ok) AS ref_hits FROM cond""")
def tier_impact(spark, d):
    """One tier replayed over the pairs that the engine looked at, with the hits of each condition."""
    l, r = _sides(spark, d)
    pairs = C.ref_token_join(l, r).unionByName(C.amount_window_join(l, r, tol.Tolerance(amount_abs=0.02))).distinct()
    tier = T.default_tiers()[0]
    rows = C.with_rows(pairs, l, r)
    a, b = F.col("l"), F.col("r")
    flags = T.explain(tier, a, b)
    return rows.select(T.holds(tier, a, b).alias("all_hold"), *flags).agg(
        F.count("*").alias("pairs"), F.count_if("all_hold").alias("accepted"), F.count_if("c2_amount_equal_within_tol").alias("amount_hits"), F.count_if("c3_ref_symmetric_in_narration").alias("ref_hits")
    )


@query("WITH " + D.PAIRS + """, o AS (SELECT session_id, l_row, r_row, tier FROM cand WHERE tier IN (1, 2)), n AS (SELECT session_id, l_row, r_row, CASE WHEN tier = 2 THEN 1 ELSE tier END AS tier FROM cand WHERE tier IN (2, 3))
SELECT coalesce(o.l_row, n.l_row) AS l_row, coalesce(o.r_row, n.r_row) AS r_row, CASE WHEN n.tier IS NULL THEN 'only_old' WHEN o.tier IS NULL THEN 'only_new' WHEN o.tier = n.tier THEN 'agree' ELSE 'tier_changed' END AS verdict
FROM o FULL JOIN n ON o.session_id = n.session_id AND o.l_row = n.l_row AND o.r_row = n.r_row""")
def full_outer_engine_diff(spark, d):
    pairs = C.candidates(*_sides(spark, d))
    new = pairs.where("tier in (2, 3)").withColumn("tier", F.when(F.col("tier") == 2, 1).otherwise(F.col("tier")))
    return R.engine_diff(pairs.where("tier in (1, 2)"), new).select("l_row", "r_row", "verdict")


@query("""WITH rates AS (SELECT date_trunc('month', o_orderdate) AS rate_date, 'USD' AS ccy, round(avg(o_totalprice) / 100000, 6) AS rate FROM orders GROUP BY 1)
SELECT o.o_orderkey, r.rate, CASE WHEN abs(o.o_totalprice - o.o_totalprice * r.rate) <= 0.01 OR abs(o.o_totalprice - o.o_totalprice * r.rate) <= abs(o.o_totalprice * r.rate) * 0.5 THEN TRUE ELSE FALSE END AS ok
FROM orders o ASOF LEFT JOIN rates r ON o.o_orderdate >= r.rate_date""")
def asof_fx(spark, d):
    o = D.table(spark, d, "orders")
    rates = o.groupBy(F.date_trunc("month", "o_orderdate").alias("rate_date")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("rate")).withColumn("ccy", F.lit("USD"))
    rows = tol.with_rate(o.withColumn("ccy", F.lit("USD")), rates, date="o_orderdate", ccy="ccy")
    a = F.col("o_totalprice")
    there = a * F.col("rate")
    ok = tol.amount_ok(there, a, tol.Tolerance()) | tol.amount_ok(a, a, tol.Tolerance(amount_abs=-1.0, fx_bps=5000.0), F.col("rate"))
    return rows.select("o_orderkey", "rate", F.coalesce(ok, F.lit(False)).alias("ok"))
