"""Queries over whole runs, review decisions, anchors, certificates and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import analytics as A
from tallyloom.operators import candidates as C
from tallyloom.operators import ledger, listings, resolve, reviews
from tallyloom.operators import session as R
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


# -- runs ----------------------------------------------------------------------------------------------------------


def _run_sessions(spark):
    """Eight sessions: 4 belongs to a one-sided account with a wide tolerance, 6 is running, 7 is closed."""
    rows = spark.range(D.SESSIONS).select(F.col("id").alias("session_id"), (F.col("id") + 100).alias("account_id"), F.when(F.col("id") == 4, "one_sided").otherwise("two_sided").alias("kind"))
    never = F.lit(None).cast("timestamp")
    started = F.when(F.col("session_id") == 6, F.lit("2024-01-01").cast("timestamp"))
    return rows.withColumn("status", F.when(F.col("session_id") == 7, "closed").otherwise("open")).withColumn("locked_at", never).withColumn("started_at", started).withColumn("finished_at", never)


_RUN = D.PAIRS + """,
run AS (SELECT session_id, l_row, r_row, abs(amount_diff) AS gap, CASE WHEN session_id = 4 THEN CASE WHEN ref_ok AND abs(amount_diff) <= 40 THEN 1 WHEN ref_ok THEN 2 END
   WHEN amount_ok AND ref_ok THEN 1 WHEN ref_ok THEN 2 WHEN amount_ok AND same_day THEN 3 WHEN amount_ok AND next_day THEN 4 END AS tier FROM pairs WHERE l_row = r_row AND session_id < 6),
won AS (SELECT * FROM run WHERE tier IS NOT NULL)"""


@query("WITH " + _RUN + """ SELECT 'assignment' AS what, session_id, l_row AS row_number, tier, CASE WHEN tier = 1 OR (tier = 2 AND gap <= 50) THEN 'confirmed' ELSE 'pending' END AS status,
  CASE WHEN tier = 1 THEN 'auto' WHEN tier = 2 AND gap <= 50 THEN 'rule 5' END AS decided_by FROM won
UNION ALL SELECT 'statement', session_id, row_number, NULL, NULL, NULL FROM stmt WHERE session_id < 6 AND row_number NOT IN (SELECT l_row FROM won)
UNION ALL SELECT 'ledger', session_id, row_number, NULL, NULL, NULL FROM ledg WHERE session_id < 6 AND row_number NOT IN (SELECT r_row FROM won)
UNION ALL SELECT 'refused', s, NULL, NULL, r, NULL FROM (VALUES (6, 'in progress'), (7, 'closed')) v(s, r)""")
def reconcile_session(spark, d):
    """A whole run: a one-sided account with its own tolerance, a rule that confirms tier 2 with a small difference, seeded residue, refused sessions."""
    left, right = D.stmt(spark, d), D.ledg(spark, d)
    settings = spark.createDataFrame([(104, 40.0, None, None, None, None)], "account_id long, amount_tol_abs double, amount_tol_pct double, date_tol_days int, min_ref_len int, fx_tol_bps double")
    spec = "rule_id int, priority int, require_tier int, require_amount_exact boolean, max_amount_diff double, require_ref_match boolean, require_same_date boolean"
    rule = spark.createDataFrame([(5, 1, 2, None, 50.0, True, None)], spec)
    got = R.reconcile(left, right, _run_sessions(spark), settings=settings, auto_rules=rule)
    null = F.lit(None)
    out = got["assignments"].select(F.lit("assignment").alias("what"), "session_id", F.col("l_row").alias("row_number"), "tier", "status", "decided_by")
    out = out.unionByName(got["items"].select(F.col("side").alias("what"), "session_id", "row_number", null.cast("int").alias("tier"), null.cast("string").alias("status"), null.cast("string").alias("decided_by")))
    return out.unionByName(got["refused"].select(F.lit("refused").alias("what"), "session_id", null.cast("long").alias("row_number"), null.cast("int").alias("tier"), F.col("refused").alias("status"), null.cast("string").alias("decided_by")))


@query("WITH " + _RUN + """, s AS (SELECT session_id, count(*) AS n FROM (SELECT session_id, row_number FROM stmt WHERE row_number NOT IN (SELECT l_row FROM won) UNION ALL SELECT session_id, row_number FROM ledg WHERE row_number NOT IN (SELECT r_row FROM won)) GROUP BY 1)
SELECT w.session_id, count(*) AS pairs, count(*) FILTER (WHERE tier = 1) AS confirmed, coalesce(any_value(s.n), 0) AS seeded FROM won w LEFT JOIN s ON s.session_id = w.session_id GROUP BY 1""")
def session_log(spark, d):
    settings = spark.createDataFrame([(104, 40.0)], "account_id long, amount_tol_abs double")
    for c in ("amount_tol_pct", "date_tol_days", "min_ref_len", "fx_tol_bps"):
        settings = settings.withColumn(c, F.lit(None).cast("double"))
    return R.reconcile(D.stmt(spark, d), D.ledg(spark, d), _run_sessions(spark), settings=settings)["log"].select("session_id", "pairs", "confirmed", "seeded")


@query("WITH " + D.SESSIONS_SQL + """ SELECT session_id, CASE WHEN session_id % 7 = 0 THEN 'closed' WHEN account_id % 5 = 0 THEN 'locked' WHEN session_id % 3 = 0 AND rows > 1 THEN 'in progress' END AS refused FROM sess""")
def session_guards(spark, d):
    """Sessions of all accounts and months: some closed, some of locked accounts, some that are running."""
    at, never = F.col("created_at").cast("timestamp"), F.lit(None).cast("timestamp")
    rows = D.sessions(spark, d).select(
        "session_id", F.when(F.col("session_id") % 7 == 0, "closed").otherwise("open").alias("status"), F.when(F.col("account_id") % 5 == 0, at).alias("locked_at"),
        F.when(F.col("session_id") % 3 == 0, at).otherwise(never).alias("started_at"), F.when(F.col("rows") == 1, at).otherwise(never).alias("finished_at"),
    )
    return R.guarded(rows).select("session_id", "refused")


_RATED = """l AS (SELECT *, CASE WHEN row_number % 3 = 0 THEN 0.5 ELSE 2.0 END AS rate FROM stmt), r AS (SELECT * REPLACE (amount * CASE WHEN row_number % 3 = 0 THEN 0.5 ELSE 2.0 END * 1.0004 AS amount) FROM ledg)"""


@query("WITH " + D.STMT + "," + D.LEDG + "," + _RATED + """ SELECT l.session_id, l.row_number AS l_row, r.row_number AS r_row FROM l JOIN r ON l.session_id = r.session_id AND r.type = CASE l.sign WHEN 'C' THEN 'DR' ELSE 'CR' END
 AND l.value_date = r.value_date AND (abs(r.amount - l.amount) <= 0.01 OR abs(r.amount - l.amount * l.rate) <= abs(l.amount * l.rate) * 5.0 / 10000)""")
def fx_candidates(spark, d):
    """Amounts in another currency, five basis points around the converted one: found by growing bins of converted amounts."""
    rate = F.when(F.col("row_number") % 3 == 0, 0.5).otherwise(2.0)
    l, r = D.stmt(spark, d).withColumn("rate", rate), D.ledg(spark, d).withColumn("amount", F.col("amount") * rate * 1.0004)
    tiers = [T.of(3, "amount, same day", ("sign", "mirror"), ("amount", "equal_within_tol"), ("value_date", "equal"))]
    return C.candidates(l, r, tiers, tol.Tolerance(fx_bps=5.0)).select("session_id", "l_row", "r_row")


@query("""SELECT c_custkey AS account_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey / 100.0 ELSE 0.01 END AS amount_tol_abs, CASE WHEN c_custkey % 8 = 0 THEN 2 ELSE 1 END AS date_tol_days, 6 AS min_ref_len FROM customer""")
def account_tolerances(spark, d):
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    k, none = F.col("account_id"), F.lit(None)
    settings = c.where("account_id % 4 = 0").select("account_id", (k / 100.0).alias("amount_tol_abs"), none.cast("double").alias("amount_tol_pct"), F.when(k % 8 == 0, 2).alias("date_tol_days"), none.cast("int").alias("min_ref_len"), none.cast("double").alias("fx_tol_bps"))
    return tol.of_accounts(c, settings).select("account_id", "amount_tol_abs", "date_tol_days", "min_ref_len")


@query("WITH " + D.PAIRS + """ SELECT session_id, l_row, r_row FROM pairs WHERE ref_ok AND amount_ok""")
def tier_one_way_ref(spark, d):
    """The statement's reference inside the ledger row's narration, which holds it here."""
    r = D.ledg(spark, d).withColumn("narration", F.concat_ws(" ", "narration", "trn_ref")).withColumn("trn_ref", F.lit(""))
    tiers = [T.of(1, "one way", ("sign", "mirror"), ("amount", "equal_within_tol"), ("ref", "in_other_narration"))]
    return C.candidates(D.stmt(spark, d), r, tiers).select("session_id", "l_row", "r_row")


@query("WITH " + D.PAIRS + """ SELECT l_row, tier, CASE WHEN tier = 1 THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN tier = 1 THEN 'auto' END AS decided_by,
 CASE tier WHEN 1 THEN 'reference ' || ref || ' and amount agree' WHEN 2 THEN 'reference ' || ref || ' agrees, amounts differ by ' || printf('%.2f', amount_diff) WHEN 3 THEN 'amount and value date agree, no reference'
 ELSE 'amount agrees, value dates are one day apart, no reference' END AS reason FROM cand WHERE tier IS NOT NULL AND l_row = r_row""")
def assignment_reasons(spark, d):
    rows = resolve.confirmed(resolve.assigned(D.stmt(spark, d), D.ledg(spark, d)))
    return rows.select("l_row", "tier", "status", "decided_by", T.reason(F.col("tier"), F.col("amount_diff"), F.col("ref")).alias("reason"))


@query("WITH " + D.STMT + "," + D.ASSIGN + " SELECT row_number, FALSE AS ignored FROM stmt WHERE row_number NOT IN (SELECT l_row FROM assign) UNION ALL SELECT row_number, TRUE FROM stmt WHERE row_number NOT IN (SELECT l_row FROM assign WHERE status <> 'rejected')")
def free_rows(spark, d):
    l, a = D.stmt(spark, d), D.assignments(spark, d)
    part = lambda ignored: resolve.free_rows(l, a, "l", ignored).select("row_number", F.lit(ignored).alias("ignored"))
    return part(False).unionByName(part(True))


# -- continuity and anchors ----------------------------------------------------------------------------------------

FORCED_CHAIN = """c0 AS (SELECT *, sum(net) OVER (PARTITION BY account_id ORDER BY created_at) AS c, row_number() OVER (PARTITION BY account_id ORDER BY created_at) AS i FROM sess),
chain AS (SELECT account_id, i, created_at AS seq, (c - net + CASE WHEN session_id % 13 = 0 THEN 7 ELSE 0 END) / 100.0 AS opening, c / 100.0 AS closing, session_id % 5 = 0 AS forced FROM c0)"""
_FOLD = """ SELECT account_id, i, seq, NULL::DOUBLE AS anchor, NULL::DOUBLE AS gap, TRUE AS accepted, closing AS next FROM chain WHERE i = 1
 UNION ALL SELECT c.account_id, c.i, c.seq, f.next, round(c.opening - f.next, 4), {0} abs(round(c.opening - f.next, 4)) <= 0.01, CASE WHEN {0} abs(round(c.opening - f.next, 4)) <= 0.01 THEN c.closing ELSE f.next END
 FROM fold f JOIN chain c ON c.account_id = f.account_id AND c.i = f.i + 1"""


@query("WITH RECURSIVE " + D.SESSIONS_SQL + "," + FORCED_CHAIN + ", fold AS (" + _FOLD.format("forced OR") + ") SELECT account_id, seq, anchor, gap, accepted FROM fold")
def continuity_forced(spark, d):
    """Refused files leave the anchor where it was until one fits or is accepted by force."""
    from tallyloom.plans.ledgers import _chain

    chain = _chain(spark, d).withColumn("forced", F.col("session_id") % 5 == 0)
    return ledger.continuity(chain, forced="forced").select("account_id", "seq", "anchor", "gap", "accepted")


_EVENTS = """e AS (SELECT user_id AS account_id, event_id AS "at", CASE WHEN event_id % 17 = 0 THEN 'reset' WHEN event_id % 5 = 0 THEN 'seed' ELSE 'delta' END AS event, value AS amount,
  CASE WHEN event_id % 3 = 0 THEN 'DR' ELSE 'CR' END AS sign, CASE WHEN event_id % 4 = 0 THEN value END AS closing, CASE WHEN event_id % 2 = 0 THEN 'chain starts anew' ELSE 'typo' END AS reason,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"""
_ANCHOR = """CASE WHEN {refused} IS NOT NULL THEN {was} WHEN c.event = 'seed' THEN round(CASE WHEN c.sign = 'CR' THEN c.amount ELSE -c.amount END, 2) WHEN c.event = 'delta' THEN coalesce(c.closing, round({was} + CASE WHEN c.sign = 'CR' THEN c.amount ELSE -c.amount END, 2)) END"""
_WHY = "CASE WHEN c.event = 'seed' AND {was} IS NOT NULL THEN 'anchored already' WHEN c.event <> 'seed' AND {was} IS NULL THEN 'not seeded' WHEN c.event = 'reset' AND c.reason = 'typo' THEN 'reason too short' END"


def _anchor(was):
    why = _WHY.format(was=was)
    return _ANCHOR.format(refused=why, was=was) + " AS anchor, " + why + " AS refused"


@query("WITH RECURSIVE " + _EVENTS + ", fold AS (SELECT c.account_id, c.i, c.\"at\", c.event, " + _anchor("NULL::DOUBLE") + " FROM e c WHERE i = 1 UNION ALL SELECT c.account_id, c.i, c.\"at\", c.event, " + _anchor("f.anchor")
       + " FROM fold f JOIN e c ON c.account_id = f.account_id AND c.i = f.i + 1) SELECT account_id, \"at\", event, anchor, refused FROM fold")
def anchor_chain(spark, d):
    i = F.col("event_id")
    log = D.table(spark, d, "events").select(
        F.col("user_id").alias("account_id"), i.alias("at"), F.when(i % 17 == 0, "reset").when(i % 5 == 0, "seed").otherwise("delta").alias("event"), F.col("value").alias("amount"),
        F.when(i % 3 == 0, "DR").otherwise("CR").alias("sign"), F.when(i % 4 == 0, F.col("value")).alias("closing"), F.when(i % 2 == 0, "chain starts anew").otherwise("typo").alias("reason"),
    )
    return reviews.anchors(log)


# -- decisions -----------------------------------------------------------------------------------------------------

_DECISIONS = D.ASSIGN + """, log AS (SELECT l_row AS key, s AS "at", 'u' || (CASE WHEN s = 2 AND l_row % 4 = 0 THEN l_row + 1 ELSE l_row END % 3) AS actor,
  CASE WHEN s = 1 THEN CASE l_row % 6 WHEN 0 THEN 'bulk_confirm' WHEN 1 THEN 'confirm' WHEN 2 THEN 'reject' WHEN 3 THEN 'reopen' ELSE 'request_approval' END ELSE CASE WHEN l_row % 6 > 3 THEN 'approve' ELSE 'reopen' END END AS action,
  tier, status, session_id IN (3, 5) AS shut FROM assign, (VALUES (1), (2)) v(s)),
one AS (SELECT *, CASE WHEN shut THEN 'session closed' WHEN action = 'bulk_confirm' AND tier <> 1 THEN 'only tier 1 in bulk'
  WHEN NOT ((action IN ('confirm', 'bulk_confirm', 'request_approval') AND status = 'pending') OR (action = 'reject' AND status IN ('pending', 'confirmed')) OR (action = 'reopen' AND status = 'rejected')) THEN 'wrong status' END AS refused FROM log WHERE "at" = 1),
a1 AS (SELECT *, CASE WHEN refused IS NOT NULL THEN status WHEN action IN ('confirm', 'bulk_confirm') THEN 'confirmed' WHEN action = 'reject' THEN 'rejected' WHEN action = 'reopen' THEN 'pending' ELSE 'pending_approval' END AS after,
  CASE WHEN refused IS NULL AND action = 'request_approval' THEN actor END AS asked FROM one),
two AS (SELECT l.key, l."at", l.actor, l.action, a1.after AS status, CASE WHEN l.shut THEN 'session closed' WHEN NOT ((l.action = 'approve' AND a1.after = 'pending_approval') OR (l.action = 'reopen' AND a1.after = 'rejected')) THEN 'wrong status'
  WHEN l.action = 'approve' AND l.actor = asked THEN 'own request' END AS refused FROM log l JOIN a1 ON a1.key = l.key WHERE l."at" = 2),
decided AS (SELECT key, "at", actor, action, after AS status, refused FROM a1
 UNION ALL SELECT key, "at", actor, action, CASE WHEN refused IS NOT NULL THEN status WHEN action = 'approve' THEN 'confirmed' ELSE 'pending' END, refused FROM two)"""


def _judged(spark, d):
    a = D.assignments(spark, d).withColumn("key", F.col("l_row"))
    k, s = F.col("key"), F.col("at")
    first = F.when(k % 6 == 0, "bulk_confirm").when(k % 6 == 1, "confirm").when(k % 6 == 2, "reject").when(k % 6 == 3, "reopen").otherwise("request_approval")
    log = a.select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).withColumn("actor", F.concat(F.lit("u"), F.when((s == 2) & (k % 4 == 0), k + 1).otherwise(k) % 3))
    log = log.withColumn("action", F.when(s == 1, first).when(k % 6 > 3, "approve").otherwise("reopen"))
    sessions = spark.range(D.SESSIONS).select(F.col("id").alias("session_id"), F.when(F.col("id") == 3, "closed").otherwise("open").alias("status"), F.when(F.col("id") == 5, F.lit("2024-01-09").cast("timestamp")).alias("locked_at"))
    return a, reviews.judged(a, log, sessions)


@query("WITH " + _DECISIONS + ' SELECT key, "at", actor, action, status, refused FROM decided')
def decision_guards(spark, d):
    """Two decisions on every assignment: closed and locked sessions, bulk beyond tier 1, self-approval and wrong statuses are refused."""
    return _judged(spark, d)[1]


@query("WITH " + _DECISIONS + """, last AS (SELECT key, arg_max(status, "at") AS status, arg_max(actor, "at") AS actor FROM decided WHERE refused IS NULL GROUP BY 1)
SELECT l_row AS key, coalesce(last.status, assign.status) AS status, last.actor AS decided_by FROM assign LEFT JOIN last ON last.key = l_row""")
def decision_results(spark, d):
    a, found = _judged(spark, d)
    return reviews.after(a, found).select("key", "status", "decided_by")


@query("WITH " + _DECISIONS + """ SELECT a1.key, a1.actor AS requested_by FROM a1 JOIN two ON two.key = a1.key WHERE a1.after = 'pending_approval' AND NOT (two.action = 'approve' AND two.refused IS NULL)""")
def awaiting_approval(spark, d):
    """Requests that nobody else has reviewed, joined to assignments that still wait."""
    a, found = _judged(spark, d)
    granted = found.where("refused is null")
    reviewed = granted.where("action = 'approve'").select("key", F.col("actor").alias("reviewed_by"))
    requests = granted.where("action = 'request_approval'").select("key", F.col("actor").alias("requested_by"), F.col("at").alias("requested_at")).join(reviewed, "key", "left")
    return reviews.awaiting_approval(reviews.after(a, found), requests).select("key", "requested_by")


@query("WITH " + D.STMT + "," + D.LEDG + "," + D.ASSIGN + """, p AS (SELECT row_number AS id, session_id, row_number AS l, amount FROM stmt WHERE row_number NOT IN (SELECT l_row FROM assign WHERE l_row % 9 <> 0)),
t AS (SELECT p.id, p.session_id, p.amount, p.l % 3 = 1 AS two, CASE WHEN p.l % 5 = 0 THEN -1 ELSE p.l END AS r FROM p)
SELECT t.id, CASE WHEN t.two AND t.id % 2 = 0 THEN 'one side must be single' WHEN ledg.row_number IS NULL OR (t.two AND s2.row_number IS NULL) THEN 'no such row'
   WHEN a.l_row IS NOT NULL OR (t.two AND a2.l_row IS NOT NULL) THEN 'row is taken' END AS refused
FROM t LEFT JOIN ledg ON ledg.row_number = t.r AND ledg.session_id = t.session_id LEFT JOIN stmt s2 ON s2.row_number = t.id + 8 AND s2.session_id = t.session_id
 LEFT JOIN (SELECT DISTINCT l_row FROM assign WHERE status <> 'rejected') a ON a.l_row = t.id LEFT JOIN (SELECT DISTINCT l_row FROM assign WHERE status <> 'rejected') a2 ON a2.l_row = t.id + 8""")
def manual_matches(spark, d):
    """Matches made by hand: one row against one or two, some against rows that are taken or do not exist."""
    l, r, a = D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d)
    free = l.join(a.where("l_row % 9 <> 0").select(F.col("l_row").alias("row_number")), "row_number", "left_anti")
    k = F.col("row_number")
    two, target = k % 3 == 1, F.when(k % 5 == 0, -1).otherwise(k)
    proposals = free.select(k.alias("id"), "session_id", F.when(two, F.array(k, k + 8)).otherwise(F.array(k)).alias("l_rows"), F.when(two & (k % 2 == 0), F.array(target, target + 8)).otherwise(F.array(target)).alias("r_rows"))
    return reviews.manual(proposals, l, r, a).select("id", "refused")


@query("WITH " + D.ITEMS + """ SELECT item_id, side, CASE WHEN status <> 'open' THEN 'not open' WHEN item_id % 3 = 0 THEN 'same side' END AS refused FROM (SELECT item_id, status, CASE WHEN (side = 'ledger') = (item_id % 3 = 0) THEN 'ledger' ELSE 'statement' END AS side FROM items)""")
def manual_clearing(spark, d):
    i = D.items(spark, d)
    other = F.when(F.col("side") == "ledger", "statement").otherwise("ledger")
    asked = i.select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("side")).otherwise(other).alias("side"), F.lit(1).alias("row_number"))
    return ledger.manual_clearing(i, asked).select("item_id", "side", "refused")


_CLOSING = D.STMT + "," + D.LEDG + "," + D.ASSIGN


@query("WITH " + _CLOSING + """ SELECT 'session' AS what, s AS session_id, NULL AS row_number, CASE WHEN s <= 3 OR s = 7 THEN 'closed' ELSE 'open' END AS status FROM range(8) t(s)
UNION ALL SELECT 'statement', session_id, row_number, NULL FROM stmt WHERE session_id <= 3 AND row_number NOT IN (SELECT l_row FROM assign)
UNION ALL SELECT 'ledger', session_id, row_number, NULL FROM ledg WHERE session_id <= 3 AND row_number NOT IN (SELECT r_row FROM assign)""")
def close_sessions(spark, d):
    """Sessions older than two days are closed and leave their residue; session 7 was closed before and leaves none again."""
    created = F.timestamp_add("HOUR", (F.col("id") * 12).cast("int"), F.lit("2024-01-28 12:00:00").cast("timestamp"))
    s = spark.range(D.SESSIONS).select(F.col("id").alias("session_id"), created.alias("created_at"), F.when(F.col("id") == 7, "closed").otherwise("open").alias("status"))
    after, items = ledger.close(s, D.as_of(), 48, D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d), items=D.stmt(spark, d).limit(0).select("session_id", F.lit("").alias("side"), "row_number"))
    out = after.select(F.lit("session").alias("what"), "session_id", F.lit(None).cast("long").alias("row_number"), "status")
    return out.unionByName(items.select(F.col("side").alias("what"), "session_id", "row_number", F.lit(None).cast("string").alias("status")))


@query("""SELECT c_custkey AS key, s AS "at", CASE s WHEN 1 THEN 'prepare' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'sign' ELSE 'review' END WHEN 3 THEN 'sign' ELSE 'send_back' END AS action,
 CASE WHEN s = 1 THEN 'prepared' WHEN c_custkey % 3 = 0 THEN CASE WHEN s = 4 THEN 'draft' ELSE 'prepared' END WHEN s = 2 THEN 'reviewed' ELSE 'signed' END AS status,
 CASE WHEN s = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN CASE WHEN s = 4 THEN NULL ELSE 'is prepared' END WHEN s = 4 THEN 'signed and immutable' END AS refused FROM customer, (VALUES (1), (2), (3), (4)) v(s)""")
def certificate_states(spark, d):
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    at = F.col("at")
    log = c.select("key", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("at"), F.lit("u").alias("actor"))
    log = log.withColumn("action", F.when(at == 1, "prepare").when(at == 2, F.when(F.col("key") % 3 == 0, "sign").otherwise("review")).when(at == 3, "sign").otherwise("send_back"))
    return reviews.certificates(c, log).select("key", "at", "action", "status", "refused")


@query("WITH " + D.SESSIONS_SQL + """ SELECT session_id, CASE WHEN session_id % 3 = 0 THEN NULL WHEN account_id % 2 = 0 AND created_at >= DATE '1995-01-01' AND created_at <= DATE '1995-12-31' THEN TIMESTAMP '2024-01-05' END AS locked_at FROM sess""")
def certificate_locks(spark, d):
    s = D.sessions(spark, d).withColumn("status", F.when(F.col("session_id") % 3 == 0, "open").otherwise("closed")).withColumn("locked_at", F.lit(None).cast("timestamp_ntz"))
    day = lambda x: F.lit(x).cast("date")
    signed = s.where("account_id % 2 = 0").select("account_id").distinct().select("account_id", day("1995-01-01").alias("period_start"), day("1995-12-31").alias("period_end"), F.lit("2024-01-05").cast("timestamp_ntz").alias("signed_at"))
    return reviews.locked(s, signed).select("session_id", "locked_at")


# -- listings ------------------------------------------------------------------------------------------------------


def _listed(spark, d):
    """The eight sessions of stmt and ledg, under accounts of three areas; session 5 has no account."""
    s = spark.range(D.SESSIONS).select(F.col("id").alias("session_id"), F.when(F.col("id") != 5, F.col("id") % 4).alias("account_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("profile_id"))
    accounts = spark.range(4).select(F.col("id").alias("account_id"), F.concat(F.lit("account "), "id").alias("label"), F.concat(F.lit("area "), F.col("id") % 3).alias("access_area"), (F.col("id") < 3).alias("active"))
    profiles = spark.createDataFrame([(2, "two"), (4, "four"), (6, "six")], "profile_id long, name string")
    return s, accounts, profiles


_LISTED = """s AS (SELECT range AS session_id, CASE WHEN range <> 5 THEN range % 4 END AS account_id, CASE WHEN range % 2 = 0 THEN range END AS profile_id FROM range(8)),
acc AS (SELECT range AS account_id, 'account ' || range AS label, 'area ' || (range % 3) AS access_area, range < 3 AS active FROM range(4)),
prof AS (SELECT * FROM (VALUES (2, 'two'), (4, 'four'), (6, 'six')) v(profile_id, name))"""


@query("WITH " + D.ASSIGN + "," + _LISTED + """ SELECT s.session_id, label, name AS profile, (SELECT count(*) FROM assign a WHERE a.session_id = s.session_id AND status = 'pending') AS pending,
 (SELECT count(*) FROM assign a WHERE a.session_id = s.session_id AND status = 'confirmed') AS confirmed, (SELECT count(*) FROM assign a WHERE a.session_id = s.session_id AND status = 'rejected') AS rejected
FROM s LEFT JOIN acc ON acc.account_id = s.account_id LEFT JOIN prof ON prof.profile_id = s.profile_id ORDER BY s.session_id DESC LIMIT 6""")
def session_list(spark, d):
    s, accounts, profiles = _listed(spark, d)
    return listings.session_list(s, accounts, profiles, D.assignments(spark, d), limit=6).select("session_id", "label", "profile", "pending", "confirmed", "rejected")


@query("WITH " + D.ASSIGN + "," + _LISTED + """, m AS (SELECT session_id FROM s JOIN acc ON acc.account_id = s.account_id WHERE access_area IN ('area 0', 'area 1'))
SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'rejected') AS rejected,
 count(DISTINCT session_id) FILTER (WHERE status = 'pending') AS open_sessions, (SELECT count(*) FROM m) AS total_sessions FROM assign WHERE session_id IN (SELECT session_id FROM m)""")
def global_counters(spark, d):
    s, accounts, _ = _listed(spark, d)
    areas = spark.createDataFrame([("area 0",), ("area 1",)], "access_area string")
    return listings.counters(s, accounts, D.assignments(spark, d), areas)


_AGE = f"greatest(0, CAST(floor(date_diff('microsecond', opened_at, TIMESTAMP '{D.AS_OF}') / 86400000000.0) AS INTEGER))"


@query("WITH " + D.STMT + "," + D.LEDG + "," + D.ASSIGN + "," + D.ITEMS + "," + _LISTED + f""", i AS (SELECT account_id % 4 AS account_id, status, {_AGE} AS a FROM items),
st AS (SELECT account_id, count(*) FILTER (WHERE status = 'open') AS o, max(a) FILTER (WHERE status = 'open') AS old, count(*) FILTER (WHERE status = 'open' AND a <= 7) AS b1, count(*) FILTER (WHERE status = 'open' AND a > 7 AND a <= 30) AS b2,
 count(*) FILTER (WHERE status = 'open' AND a > 30 AND a <= 90) AS b3, count(*) FILTER (WHERE status = 'open' AND a > 90) AS b4, count(*) FILTER (WHERE status = 'cleared') AS c, count(*) FILTER (WHERE status = 'written_off') AS w FROM i GROUP BY 1),
n AS (SELECT acc.account_id, (SELECT max(session_id) FROM s WHERE s.account_id = acc.account_id) AS last, (SELECT count(*) FROM stmt JOIN s USING (session_id) WHERE s.account_id = acc.account_id) AS l,
 (SELECT count(*) FROM ledg JOIN s USING (session_id) WHERE s.account_id = acc.account_id) AS r, (SELECT count(*) FROM assign JOIN s USING (session_id) WHERE s.account_id = acc.account_id AND status = 'confirmed') AS k FROM acc)
SELECT n.account_id, last AS last_session, l AS statement_rows, r AS ledger_rows, k AS confirmed, round(100.0 * k / l, 1) AS match_rate, o AS open_items, old AS oldest_days, b1 AS le7, b2 AS le30, b3 AS le90, b4 AS gt90, c AS cleared, w AS written_off
FROM n JOIN st ON st.account_id = n.account_id""")
def account_status(spark, d):
    s, accounts, _ = _listed(spark, d)
    items = D.items(spark, d).withColumn("account_id", F.col("account_id") % 4)
    return listings.account_status(accounts, s, D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d), items, D.as_of())


@query("WITH " + D.STMT + "," + D.LEDG + "," + D.ASSIGN + """, l AS (SELECT session_id, count(*) AS n FROM stmt GROUP BY 1), r AS (SELECT session_id, count(*) AS n FROM ledg GROUP BY 1),
a AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE status = 'confirmed') AS c, count(DISTINCT l_row) FILTER (WHERE l_row > 0) AS lh, count(DISTINCT r_row) FILTER (WHERE r_row > 0) AS rh FROM assign GROUP BY 1)
SELECT session_id, round(100.0 * c / a.n, 1) AS of_decisions, round(100.0 * c / l.n, 1) AS of_statement, round(100.0 * (lh + rh) / (l.n + r.n), 1) AS of_rows, round(100.0 * lh / l.n, 1) AS matched_statement FROM l JOIN r USING (session_id) JOIN a USING (session_id)""")
def match_rates(spark, d):
    return listings.match_rates(D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d))


@query("""SELECT event_id AS id, event_type AS action, 'user' || (user_id % 20) AS actor, ts AS "at", json_extract_string(props, '$.k') AS k, NULL AS missing FROM events WHERE user_id % 8 = 3""")
def session_audit(spark, d):
    """The log of one session, with values of its JSON details."""
    e = D.table(spark, d, "events")
    log = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("session_id"), F.col("event_type").alias("action"), F.concat(F.lit("user"), F.col("user_id") % 20).alias("actor"), F.col("ts").alias("at"), F.col("props").alias("details"))
    return listings.audit_of(log, 3, ["k", "missing"])


@query("""WITH a AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION ALL SELECT 'NOBODY') SELECT name, (SELECT count(*) FROM customer WHERE c_mktsegment = name AND c_custkey % 3 <> 0) AS accounts_count FROM a""")
def area_usage(spark, d):
    c = D.table(spark, d, "customer")
    areas = c.select(F.col("c_mktsegment").alias("name")).distinct().unionByName(spark.createDataFrame([("NOBODY",)], "name string"))
    return listings.area_usage(areas, c.select(F.col("c_mktsegment").alias("access_area"), (F.col("c_custkey") % 3 != 0).alias("active")))


@query("""SELECT s_suppkey AS profile_id, c_custkey AS account_id, c_name AS ac_no, c_mktsegment AS bound_ccy FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 10 WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0""")
def profile_accounts(spark, d):
    k = F.col("s_suppkey")
    profiles = D.table(spark, d, "supplier").select(k.alias("profile_id"), (k * 10).alias("account_id"), (k % 4 != 0).alias("active"), F.when(k % 5 == 0, "").otherwise("*.csv").alias("filename_pattern"))
    accounts = D.table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("ac_no"), F.col("c_mktsegment").alias("ccy"))
    return listings.profiles_with_account(profiles, accounts).withColumn("account_id", F.when(F.col("ac_no").isNotNull(), F.col("account_id"))).select("profile_id", "account_id", "ac_no", "bound_ccy")


@query("WITH " + D.CARDS + """ SELECT scheme_ref, stage, amount, CASE WHEN file_id = 2 THEN 'beta' ELSE 'alpha' END AS scheme FROM cards WHERE file_id IN (2, 3)""")
def card_file_records(spark, d):
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    files = spark.range(1, 4).select(F.col("id").alias("file_id"), F.when(F.col("id") == 2, "beta").otherwise("alpha").alias("scheme"), F.element_at(F.array(F.lit("auth"), F.lit("clearing"), F.lit("settlement")), F.col("id").cast("int")).alias("stage"), day(F.col("id").cast("int")).alias("settlement_date"))
    rows = listings.records_of_files(D.card_records(spark, d).drop("stage"), files, since=day(F.lit(2)), until=day(F.lit(3)))
    return rows.select("scheme_ref", "stage", "amount", "scheme")


@query("WITH " + D.STMT + "," + D.LEDG + """, p AS (SELECT l.session_id, l.row_number, min(r.row_number) AS item_id FROM stmt l JOIN ledg r ON r.session_id = l.session_id AND l.sign = 'D' AND r.type = 'CR' AND abs(r.amount - l.amount) < 0.01 AND NOT contains(r.trn_ref, l.our_ref) GROUP BY 1, 2)
SELECT session_id, row_number, item_id FROM p ORDER BY md5('7|' || session_id || '|' || row_number), 1, 2 LIMIT 40""")
def decoy_sample(spark, d):
    """Equal amounts without a reference in common: a seeded sample for the rule builder."""
    left = D.stmt(spark, d).withColumn("account_id", F.col("session_id"))
    items = D.ledg(spark, d).select(F.col("session_id").alias("account_id"), F.col("row_number").alias("item_id"), F.lit("ledger").alias("side"), F.col("type").alias("sign"), "amount", F.col("trn_ref").alias("ref"))
    return listings.decoys(left, items, limit=40).select("session_id", "row_number", "item_id")


@query("WITH " + D.STMT + "," + D.LEDG + "," + D.ASSIGN + """, x AS (SELECT session_id, CASE WHEN l_row % 10 = 0 THEN 0 ELSE l_row END AS l_row, r_row, tier, CASE WHEN l_row % 10 = 0 THEN l_row END AS item_id FROM assign)
SELECT x.session_id, x.l_row, x.r_row, tier, CASE WHEN item_id IS NULL THEN stmt.amount ELSE item_id * 2.0 END AS l_amount, CASE WHEN item_id IS NULL THEN our_ref ELSE 'ITEM' || item_id END AS l_ref, ledg.amount AS r_amount, trn_ref AS r_ref, item_id IS NOT NULL AS carried
FROM x LEFT JOIN stmt ON stmt.row_number = x.l_row AND x.l_row > 0 LEFT JOIN ledg ON ledg.row_number = x.r_row AND x.r_row > 0""")
def export_resolved(spark, d):
    """Assignments to carried items (row 0 on the statement side) are exported with the item's amount and reference."""
    a = D.assignments(spark, d)
    carried = F.col("l_row") % 10 == 0
    rows = a.select("session_id", F.when(carried, 0).otherwise(F.col("l_row")).alias("l_row"), "r_row", "tier", F.when(carried, F.col("l_row")).alias("item_id"))
    items = a.where(carried).select(F.col("l_row").alias("item_id"), F.lit("statement").alias("side"), (F.col("l_row") * 2.0).alias("amount"), F.concat(F.lit("ITEM"), "l_row").alias("ref"))
    return listings.exported(rows, D.stmt(spark, d), D.ledg(spark, d), items)


@query("WITH " + D.ASSIGN + " SELECT l_row, tier, amount FROM assign ORDER BY tier, amount DESC, l_row LIMIT 200")
def report_order(spark, d):
    return listings.reported(D.assignments(spark, d)).limit(200).select("l_row", "tier", "amount")


@query("WITH " + D.ITEMS + """ SELECT item_id FROM (SELECT item_id, opened_at, category, CASE WHEN item_id % 5 <> 2 THEN functional_group END AS g FROM items) ORDER BY g NULLS LAST, category NULLS LAST, opened_at, item_id LIMIT 300 OFFSET 100""")
def nulls_last_order(spark, d):
    i = D.items(spark, d)
    return listings.by_team(i.withColumn("functional_group", F.when(F.col("item_id") % 5 != 2, F.col("functional_group")))).offset(100).limit(300).select("item_id")


@query("WITH " + D.ASSIGN + """ SELECT l_row, (SELECT count(*) FROM assign WHERE status = 'pending') AS total FROM (SELECT l_row FROM assign WHERE status = 'pending' ORDER BY tier, l_row LIMIT 25 OFFSET 50)""")
def review_page_total(spark, d):
    rows, total = listings.paged(D.assignments(spark, d).where("status = 'pending'"), ["tier", "l_row"], 50, 25)
    return rows.crossJoin(F.broadcast(total)).select("l_row", "total")  # one row


@query("""SELECT user_id AS job_id, event_id AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p <= 20""")
def runs_to_keep(spark, d):
    return reviews.runs_to_keep(D.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("run_id")))


@query("WITH " + D.ITEMS + """ SELECT functional_group, count(*) AS items, round(sum(amount), 2) AS amount, count(*) FILTER (WHERE item_id % 2 = 1) AS notes FROM items WHERE status = 'written_off' GROUP BY 1""")
def write_offs(spark, d):
    i = D.items(spark, d)
    return listings.write_offs(i, i.where("item_id % 2 = 1").select("item_id"))


@query("""SELECT o_orderkey FROM orders WHERE NOT contains(upper(o_orderpriority), 'URG') AND NOT contains(upper(o_orderpriority), upper(o_orderstatus))""")
def glob_exclusion(spark, d):
    p = F.col("o_orderpriority")
    return D.table(spark, d, "orders").where(text.unlike(p, "urg") & text.unlike(p, F.col("o_orderstatus"))).select("o_orderkey")


@query("WITH " + D.CARDS + """, g AS (SELECT scheme_ref, list_sort(list(DISTINCT stage)) AS s FROM cards GROUP BY 1) SELECT scheme_ref, array_to_string(s, ',') AS stages FROM g""")
def card_group_stages(spark, d):
    from tallyloom.operators import groups

    return groups.groups(D.card_records(spark, d)).select("scheme_ref", F.array_join("stages", ",").alias("stages"))


@query("WITH " + D.CARDS + """, g AS (SELECT scheme_ref, count(DISTINCT file_id) AS files, max(amount) - min(amount) AS spread, count(DISTINCT stage) AS stages FROM cards GROUP BY 1),
s AS (SELECT *, CASE WHEN files <= 1 THEN 4 WHEN spread > 0.01 + 1e-9 THEN 1 WHEN stages < 3 THEN 2 ELSE 3 END AS rank FROM g)
SELECT scheme_ref FROM s ORDER BY rank, spread DESC, scheme_ref LIMIT 100 OFFSET 1300""")
def card_group_order(spark, d):
    from tallyloom.operators import groups

    return groups.ordered(groups.groups(D.card_records(spark, d))).offset(1300).limit(100).select("scheme_ref")


@query("WITH " + D.ITEMS + """ SELECT account_id FROM items WHERE status = 'open' UNION SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0""")
def account_key_union(spark, d):
    one = D.items(spark, d).where("status = 'open'").select("account_id")
    return one.unionByName(D.table(spark, d, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("account_id"))).distinct()
