"""Queries over reports: ageing, KPIs, breaks, patterns, sessions, certificates, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import analytics as A
from tallyloom.plans import derived as D

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


I, S = "WITH " + D.ITEMS, "WITH " + D.ASSIGN
_TS = f"TIMESTAMP '{D.AS_OF}'"
_AGE = f"CAST(floor(date_diff('microsecond', opened_at, {_TS}) / 86400000000.0) AS INTEGER)"
_DAY = "DATE '2024-02-01'"


def _today():
    return F.lit("2024-02-01").cast("date")


@query(I + f" SELECT CASE WHEN a < 0 THEN NULL WHEN a <= 1 THEN '0-1' WHEN a <= 3 THEN '2-3' WHEN a <= 7 THEN '4-7' WHEN a <= 30 THEN '8-30' ELSE '31+' END AS bucket, count(*) AS items, round(sum(amount), 2) AS amount FROM (SELECT *, {_AGE} AS a FROM items WHERE status = 'open') GROUP BY 1")
def ageing_dashboard(spark, d):
    return A.ageing_dashboard(D.items(spark, d), D.as_of())


_ACC = "CASE WHEN a <= 7 THEN '<=7' WHEN a <= 30 THEN '<=30' WHEN a <= 90 THEN '<=90' ELSE '>90' END"


@query(I + f" SELECT side, category, {_ACC} AS bucket, count(*) AS items, round(sum(amount), 2) AS amount FROM (SELECT *, greatest(0, {_AGE}) AS a FROM items WHERE status = 'open') GROUP BY 1, 2, 3")
def ageing_account(spark, d):
    return A.ageing_account(D.items(spark, d), D.as_of(), ["side", "category"])


@query(I + f""" SELECT account_id, count(*) AS items, round(sum(amount), 2) AS amount, max(a) AS oldest, count(*) FILTER (WHERE a <= 7) AS le7, count(*) FILTER (WHERE a > 7 AND a <= 30) AS le30, count(*) FILTER (WHERE a > 30 AND a <= 90) AS le90, count(*) FILTER (WHERE a > 90) AS gt90
FROM (SELECT *, greatest(0, {_AGE}) AS a FROM items WHERE status = 'open') GROUP BY 1""")
def account_rollup(spark, d):
    return A.account_rollup(D.items(spark, d), D.as_of())


_BY = "count(*) AS items, round(sum(amount), 2) AS amount, min(opened_at) AS oldest, max(opened_at) AS newest FROM items WHERE status = 'open' GROUP BY 1"


@query(I + " SELECT functional_group, " + _BY)
def open_by_group(spark, d):
    return A.open_by(D.items(spark, d), "functional_group")


@query(I + " SELECT account_id, " + _BY + " ORDER BY 2 DESC, 1 LIMIT 10")
def open_by_account_topn(spark, d):
    return A.top_by_count(D.items(spark, d), "account_id", 10)


@query(S + f" SELECT coalesce(assignee, 'unassigned') AS assignee, count(*) AS pending, count(*) FILTER (WHERE due_date < {_DAY}) AS overdue, count(*) FILTER (WHERE priority IN ('high', 'urgent')) AS pressing FROM assign WHERE status = 'pending' GROUP BY 1")
def case_load(spark, d):
    return A.case_load(D.assignments(spark, d), _today())


@query("WITH " + D.ITEMS + "," + D.ASSIGN + f""", r AS (SELECT count(*) * 2 AS n FROM orders)
SELECT (SELECT round(100.0 * count(*) FILTER (WHERE tier = 1) / nullif(count(*), 0), 1) FROM assign WHERE status = 'confirmed' AND decided_at >= {_TS} - INTERVAL 14 DAY) AS tier1_rate,
 (SELECT round(100.0 * (n - (SELECT count(*) FROM items)) / nullif(n, 0), 1) FROM r) AS row_rate,
 (SELECT CAST(floor(date_diff('microsecond', min(opened_at), {_TS}) / 86400000000.0) AS INTEGER) FROM items WHERE status = 'open') AS oldest_open,
 (SELECT count(*) FROM assign WHERE status = 'pending' AND due_date < {_DAY}) AS sla_breached""")
def kpis(spark, d):
    seen = D.table(spark, d, "orders").agg((F.count("*") * 2).alias("n"))
    return A.kpis(D.assignments(spark, d), D.items(spark, d), seen, D.as_of(), _today())


@query(S + f""", days AS (SELECT CAST(unnest(generate_series({_DAY} - 44, {_DAY}, INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(decided_at AS DATE) AS day, count(*) FILTER (WHERE status = 'confirmed') AS c, count(*) FILTER (WHERE status = 'rejected') AS r, count(*) FILTER (WHERE status = 'pending') AS p FROM assign GROUP BY 1)
SELECT days.day, coalesce(c, 0) AS confirmed, coalesce(r, 0) AS rejected, coalesce(p, 0) AS pending, coalesce(c + r + p, 0) AS total FROM days LEFT JOIN c ON c.day = days.day""")
def trend_zero_fill(spark, d):
    return A.trend(D.assignments(spark, d), _today(), 45)


@query("WITH " + D.ITEMS + "," + D.ASSIGN + """ SELECT 'category' AS dimension, category AS key, status AS part, count(*) AS n, round(sum(amount), 2) AS amount FROM items GROUP BY 2, 3
UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), status, count(*), round(sum(amount), 2) FROM items GROUP BY 2, 3
UNION ALL SELECT 'month', strftime(opened_at, '%Y-%m'), status, count(*), round(sum(amount), 2) FROM items GROUP BY 2, 3
UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), source, count(*), round(sum(amount_diff), 2) FROM assign GROUP BY 2, 3""")
def break_analysis(spark, d):
    return A.break_analysis(D.items(spark, d), D.assignments(spark, d))


@query(S + " SELECT coalesce(decided_by, 'unknown') AS user, CAST(decided_at AS DATE) AS day, count(*) AS decisions, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM assign WHERE decided_at IS NOT NULL GROUP BY 1, 2")
def decisions_by_user(spark, d):
    return A.decisions_by_user(D.assignments(spark, d))


@query("WITH " + D.LEDG + "," + D.ASSIGN + """, r AS (SELECT a.status = 'confirmed' AS ok, upper(narration) AS n, trn_ref, user_id, module FROM assign a JOIN ledg ON ledg.row_number = a.r_row WHERE status IN ('confirmed', 'rejected')),
p AS (SELECT 'token' AS kind, unnest(list_distinct(list_filter(regexp_extract_all(n, '[A-Z][A-Z0-9]{3,}'), lambda w: w NOT IN ('THE', 'AND', 'FOR', 'WITH', 'FROM', 'PAYMENT', 'TRANSFER')))) AS value, ok FROM r
 UNION ALL SELECT 'prefix', substr(trn_ref, 1, 4), ok FROM r WHERE length(trn_ref) >= 4 UNION ALL SELECT 'user', user_id, ok FROM r UNION ALL SELECT 'module', module, ok FROM r),
g AS (SELECT kind, value, count(*) AS total, count(*) FILTER (WHERE ok) AS confirmed FROM p GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT kind, value, total, confirmed, round(100.0 * confirmed / total, 1) AS rate, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CAST(confirmed AS DOUBLE) / total DESC, total DESC, value) AS place FROM g)
WHERE place <= CASE kind WHEN 'token' THEN 50 ELSE 30 END""")
def match_patterns(spark, d):
    a, r = D.assignments(spark, d), D.ledg(spark, d)
    rows = a.select("status", F.col("r_row").alias("row_number")).join(r.select("row_number", "narration", "trn_ref", "user_id", "module"), "row_number")
    return A.match_patterns(rows)


_SIDES = D.STMT + "," + D.LEDG + "," + D.ASSIGN


def _totals_sql(rows, at, credit):
    done = f"row_number IN (SELECT {at}_row FROM assign WHERE status = 'confirmed')"
    s = lambda c: f"round(sum(CASE WHEN {c} THEN amount ELSE 0.0 END), 2)"
    return f"SELECT session_id, {s(credit)} AS credits, {s('NOT ' + credit)} AS debits, {s(credit + ' AND ' + done)} AS credits_done, {s('NOT ' + credit + ' AND ' + done)} AS debits_done, count(*) AS rows, '{at}' AS side FROM {rows} GROUP BY 1"


@query("WITH " + _SIDES + " " + _totals_sql("stmt", "l", "(sign = 'C')") + " UNION ALL " + _totals_sql("ledg", "r", "(type = 'CR')"))
def session_totals(spark, d):
    return A.session_totals(D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d))


@query(S + " SELECT session_id, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'rejected') AS rejected, round(100.0 * count(*) FILTER (WHERE status = 'confirmed') / count(*), 1) AS match_rate FROM assign GROUP BY 1")
def session_rates(spark, d):
    return A.session_rates(D.assignments(spark, d))


def _sess(spark, d):
    return D.sessions(spark, d).withColumn("opening", F.col("rows") * 1.0).withColumn("closing", F.col("net") / 100.0)


@query("WITH " + D.ITEMS + "," + D.SESSIONS_SQL + """, n AS (SELECT session_id, count(*) AS s, count(*) FILTER (WHERE status = 'cleared') AS c FROM items GROUP BY 1)
SELECT account_id, sess.session_id, coalesce(s, 0) AS seeded, coalesce(c, 0) AS cleared, coalesce(s - c, 0) AS net_items, CAST(sum(coalesce(s - c, 0)) OVER (PARTITION BY account_id ORDER BY created_at, sess.session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
FROM sess LEFT JOIN n ON n.session_id = sess.session_id""")
def session_timeline(spark, d):
    return A.session_timeline(_sess(spark, d), D.items(spark, d)).select("account_id", "session_id", "seeded", "cleared", "net_items", "running")


_OPEN = "status = 'open' AND CAST(opened_at AS DATE) <= DATE '2024-01-20'"


@query("WITH " + D.ITEMS + "," + D.ASSIGN + "," + D.SESSIONS_SQL + f""", w AS (SELECT * FROM sess WHERE CAST(created_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31')
SELECT 'category' AS metric, category AS key, count(*) AS n, round(sum(abs(amount)), 2) AS amount FROM items WHERE {_OPEN} GROUP BY 2
UNION ALL SELECT 'team', functional_group, count(*), round(sum(abs(amount)), 2) FROM items WHERE {_OPEN} GROUP BY 2
UNION ALL SELECT 'assignments', status, count(*), round(sum(abs(amount)), 2) FROM assign WHERE session_id IN (SELECT session_id FROM w) GROUP BY 2
UNION ALL SELECT 'open', 'all', count(*), round(sum(abs(amount)), 2) FROM items WHERE {_OPEN}
UNION ALL SELECT 'sessions', 'all', count(*), NULL FROM w
UNION ALL SELECT 'balance', 'opening', NULL, (SELECT rows * 1.0 FROM w ORDER BY session_id LIMIT 1) UNION ALL SELECT 'balance', 'closing', NULL, (SELECT net / 100.0 FROM w ORDER BY session_id DESC LIMIT 1)""")
def certificate_figures(spark, d):
    cut = F.lit("2024-01-20").cast("date")
    items = D.items(spark, d).where(F.col("opened_at").cast("date") <= cut)
    sess = _sess(spark, d)
    return A.certificate(items, D.assignments(spark, d), sess.where("created_at < '1996-01-01'"), F.lit("1995-01-01").cast("date"), cut)


@query(I + " SELECT CASE WHEN ccy <> 'LCY' THEN ccy ELSE functional_group END AS tab, count(*) AS n, round(sum(CASE WHEN sign IN ('C', 'CR') THEN amount ELSE 0.0 END), 2) AS cr, round(sum(CASE WHEN sign IN ('C', 'CR') THEN 0.0 ELSE amount END), 2) AS dr, round(sum(CASE WHEN sign IN ('C', 'CR') THEN amount ELSE -amount END), 2) AS net FROM items WHERE status = 'open' AND CAST(opened_at AS DATE) <= DATE '2024-01-25' GROUP BY 1")
def daily_breaks_totals(spark, d):
    return A.daily_breaks(D.items(spark, d), F.lit("2024-01-25").cast("date"))


def _feed(name, days, escalate):
    age = f"date_diff('microsecond', opened_at, {_TS}) / 86400000000.0"
    more = " AND acknowledged_at IS NULL" if escalate else ""
    O[name] = I + f" SELECT item_id, account_id, opened_at FROM items WHERE status = 'open' AND (snoozed_until IS NULL OR snoozed_until <= {_TS}) AND {age} >= {days * (2 if escalate else 1)}{more} ORDER BY opened_at, item_id LIMIT 500"

    def run(spark, d):
        return A.sla_feed(D.items(spark, d), D.as_of(), days, escalate=escalate).select("item_id", "account_id", "opened_at")

    Q[name] = run


_feed("sla_feed", 5.5, False)
_feed("sla_escalation", 5.5, True)


@query(I + """ SELECT item_id, opened_at AS at, 'opened' AS what, category AS detail FROM items UNION ALL SELECT item_id, cleared_at, 'cleared', ref FROM items WHERE cleared_at IS NOT NULL
UNION ALL SELECT item_id, acknowledged_at, 'acknowledged', ref FROM items WHERE acknowledged_at IS NOT NULL""")
def item_timeline_union(spark, d):
    i = D.items(spark, d)
    part = lambda at, what, detail: i.where(F.col(at).isNotNull()).select("item_id", F.col(at).alias("at"), F.lit(what).alias("what"), F.col(detail).alias("detail"))
    return A.timeline(part("opened_at", "opened", "category"), part("cleared_at", "cleared", "ref"), part("acknowledged_at", "acknowledged", "ref"))


def _log(spark, d):
    e = D.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("user"), F.col("user_id") % 20).alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("details"))


_LOG = "WITH log AS (SELECT event_id AS id, ts AS \"at\", 'user' || (user_id % 20) AS actor, event_type AS action, props AS details FROM events)"


@query(_LOG + " SELECT 'actor' AS facet, actor AS value, count(*) AS n FROM log GROUP BY 2 UNION ALL SELECT 'action', action, count(*) FROM log GROUP BY 2")
def facets(spark, d):
    return A.facets(_log(spark, d))


@query(_LOG + " SELECT id, \"at\", actor, action FROM log WHERE contains(lower(details), '\"k\": 4') AND actor = 'user3' AND \"at\" >= DATE '2024-01-05' AND \"at\" < DATE '2024-01-21' ORDER BY \"at\" DESC, id DESC LIMIT 100")
def activity_search(spark, d):
    day = lambda s: F.lit(s).cast("date")
    found = A.search(_log(spark, d), text='"k": 4', actor="user3", since=day("2024-01-05"), until=day("2024-01-20"))
    return found.orderBy(F.desc("at"), F.desc("id")).limit(100).select("id", "at", "actor", "action")


@query("WITH " + _SIDES + """, b AS (SELECT *, row_number() OVER (PARTITION BY session_id, l_row ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, tier) AS p FROM assign)
SELECT stmt.session_id, 'l' AS side, row_number, stmt.amount, sign, our_ref AS ref, coalesce(status, 'unmatched') AS status, tier FROM stmt LEFT JOIN b ON b.l_row = row_number AND p = 1
UNION ALL SELECT ledg.session_id, 'r', row_number, ledg.amount, type, trn_ref, coalesce(status, 'unmatched'), tier FROM ledg LEFT JOIN b ON b.r_row = row_number AND p = 1""")
def session_register(spark, d):
    return A.register(D.stmt(spark, d), D.ledg(spark, d), D.assignments(spark, d)).drop("value_date")


@query(S + " SELECT l_row, tier, status FROM assign WHERE status = 'pending' ORDER BY tier, abs(amount_diff), l_row LIMIT 50 OFFSET 100")
def review_page(spark, d):
    a = D.assignments(spark, d).where("status = 'pending'")
    return A.page(a, ["tier", F.abs("amount_diff"), "l_row"], 100, 50).select("l_row", "tier", "status")


@query("WITH " + D.SESSIONS_SQL + " SELECT account_id, arg_max(session_id, created_at) AS session_id, max(created_at) AS created_at FROM sess GROUP BY 1")
def latest_session_per_account(spark, d):
    return A.latest_per(D.sessions(spark, d), "account_id", "created_at", "session_id")


@query("WITH " + D.SESSIONS_SQL + " SELECT account_id, session_id, lag(session_id) OVER (PARTITION BY account_id ORDER BY created_at, session_id) AS previous_session_id FROM sess")
def prev_session_lag(spark, d):
    return A.previous(D.sessions(spark, d), "account_id", ["created_at", "session_id"], "session_id").select("account_id", "session_id", "previous_session_id")


@query("WITH " + D.ACCOUNTS + " SELECT account_id, label, access_area FROM accounts WHERE access_area IN ('BUILDING', 'MACHINERY')")
def semi_scope(spark, d):
    areas = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "access_area string")
    return A.scoped(D.accounts(spark, d), areas).select("account_id", "label", "access_area")


@query("WITH " + D.ITEMS + "," + D.ACCOUNTS + " SELECT access_area, country, count(*) AS items, count(DISTINCT i.account_id) AS accounts, round(sum(i.amount), 2) AS amount FROM items i LEFT JOIN accounts a ON a.account_id = i.account_id GROUP BY 1, 2")
def open_items_by_area(spark, d):
    rows = D.items(spark, d).join(D.accounts(spark, d), "account_id", "left")
    return rows.groupBy("access_area", "country").agg(F.count("*").alias("items"), F.countDistinct("account_id").alias("accounts"), F.round(F.sum("amount"), 2).alias("amount"))


@query("WITH " + D.ITEMS + """, a AS (SELECT account_id, count(*) AS n FROM items WHERE CAST(opened_at AS DATE) = DATE '2024-01-10' GROUP BY 1), b AS (SELECT account_id, count(*) AS n FROM items WHERE CAST(opened_at AS DATE) = DATE '2024-01-11' GROUP BY 1)
SELECT coalesce(a.account_id, b.account_id) AS account_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, CASE WHEN b.n IS NULL THEN 'gone' WHEN a.n IS NULL THEN 'new' ELSE 'kept' END AS verdict FROM a FULL JOIN b ON a.account_id = b.account_id""")
def day_set_comparison(spark, d):
    i = D.items(spark, d)
    n = lambda day, name: i.where(F.col("opened_at").cast("date") == day).groupBy("account_id").agg(F.count("*").alias(name))
    rows = n("2024-01-10", "a").join(n("2024-01-11", "b"), "account_id", "full_outer")
    verdict = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").otherwise("kept")
    return rows.select("account_id", F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"), verdict.alias("verdict"))
