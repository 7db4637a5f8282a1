"""Queries over what people do to cases and open items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import casework
from tallyloom.plans import derived as D

Q, O = {}, {}


def query(sql):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


_PATCHES = D.ASSIGN + """, p AS (SELECT l_row % 5000 AS l_row, event_id AS tm, CASE event_id % 4 WHEN 0 THEN 'user' || (event_id % 9) WHEN 1 THEN '' END AS assignee,
 CASE event_id % 5 WHEN 0 THEN '2024-03-' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') WHEN 1 THEN '' END AS due_date, CASE event_id % 6 WHEN 0 THEN 'urgent' WHEN 1 THEN 'asap' END AS priority FROM (SELECT *, event_id * 7 AS l_row FROM events)),
k AS (SELECT p.*, CASE WHEN assignee IS NULL AND due_date IS NULL AND priority IS NULL THEN 'nothing to update' WHEN priority = 'asap' THEN 'unknown priority' WHEN due_date <> '' AND try_strptime(due_date, '%Y-%m-%d') IS NULL THEN 'no date' END AS refused FROM p WHERE l_row IN (SELECT l_row FROM assign))"""


def _patches(spark, d):
    i = F.col("event_id")
    log = D.table(spark, d, "events").select(
        (i * 7 % 5000).alias("l_row"), i.alias("at"), F.lit("u").alias("actor"), F.when(i % 4 == 0, F.concat(F.lit("user"), i % 9)).when(i % 4 == 1, "").alias("assignee"),
        F.when(i % 5 == 0, F.concat(F.lit("2024-03-"), F.lpad((i % 40).cast("string"), 2, "0"))).when(i % 5 == 1, "").alias("due_date"), F.when(i % 6 == 0, "urgent").when(i % 6 == 1, "asap").alias("priority"),
    )
    return casework.patched(D.assignments(spark, d), log, "l_row")


@query("WITH " + _PATCHES + """, n AS (SELECT l_row, arg_max(assignee, tm) FILTER (WHERE assignee IS NOT NULL) AS a, arg_max(due_date, tm) FILTER (WHERE due_date IS NOT NULL) AS d, arg_max(priority, tm) FILTER (WHERE priority IS NOT NULL) AS p FROM k WHERE refused IS NULL GROUP BY 1)
SELECT l_row, CASE WHEN n.a IS NULL THEN assignee ELSE nullif(n.a, '') END AS assignee, CASE WHEN n.d IS NULL THEN due_date ELSE CAST(try_strptime(nullif(n.d, ''), '%Y-%m-%d') AS DATE) END AS due_date, coalesce(n.p, priority) AS priority FROM assign LEFT JOIN n USING (l_row)""")
def case_patches(spark, d):
    return _patches(spark, d)[0].select("l_row", "assignee", "due_date", "priority")


@query("WITH " + _PATCHES + " SELECT l_row, tm, refused FROM k WHERE refused IS NOT NULL")
def case_patches_refused(spark, d):
    return _patches(spark, d)[1].select("l_row", F.col("at").alias("tm"), "refused")


@query("WITH " + D.ASSIGN + """, c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'assignment' WHEN 1 THEN 'open_item' ELSE 'file' END AS kind, event_id * 3 AS id, CASE event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 4001) WHEN 2 THEN NULL ELSE ' note ' || event_id END AS body FROM events)
SELECT event_id, CASE WHEN kind = 'file' THEN 'unknown type' WHEN trim(coalesce(body, '')) = '' THEN 'empty' WHEN length(trim(body)) > 4000 THEN 'too long' WHEN kind = 'assignment' AND id NOT IN (SELECT l_row FROM assign) OR kind = 'open_item' AND id NOT IN (SELECT event_id FROM events) THEN 'no such target' END AS refused, length(trim(coalesce(body, ''))) AS n FROM c""")
def case_comments(spark, d):
    i, e = F.col("event_id"), D.table(spark, d, "events")
    log = e.select(i, F.when(i % 3 == 0, "assignment").when(i % 3 == 1, "open_item").otherwise("file").alias("target_type"), (i * 3).alias("target_id"), i.alias("at"), F.lit("u").alias("author"),
                   F.when(i % 7 == 0, "  ").when(i % 7 == 1, F.repeat(F.lit("x"), F.lit(4001))).when(i % 7 != 2, F.concat(F.lit(" note "), i)).alias("body"))
    got = casework.commented(log, {"assignment": D.assignments(spark, d).select(F.col("l_row").alias("target_id")), "open_item": e.select(i.alias("target_id"))})
    return got.select("event_id", "refused", F.length("body").cast("long").alias("n"))


@query("WITH " + D.ITEMS + """, l AS (SELECT o_orderkey % 8000 AS item_id, o_orderkey AS k, o_orderdate AS tm, CASE o_orderkey % 4 WHEN 0 THEN 'snooze' WHEN 1 THEN 'acknowledge' WHEN 2 THEN 'assign' ELSE 'shout' END AS action, o_orderkey % 100 AS days, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'user' || (o_orderkey % 5) END AS who FROM orders),
j AS (SELECT l.*, status = 'open' AND action <> 'shout' AND (action <> 'snooze' OR days BETWEEN 1 AND 90) AS ok FROM l JOIN items USING (item_id)),
n AS (SELECT item_id, max(struct_pack(tm := tm, days := days)) FILTER (WHERE ok AND action = 'snooze') AS s, max(struct_pack(tm := tm, who := who)) FILTER (WHERE ok AND action = 'acknowledge') AS a, max(struct_pack(tm := tm, who := who)) FILTER (WHERE ok AND action = 'assign') AS g, count(*) FILTER (WHERE NOT ok) AS refused FROM j GROUP BY 1)
SELECT item_id, coalesce(CAST(n.s.tm AS TIMESTAMP) + to_days(CAST(n.s.days AS INTEGER)), snoozed_until) AS snoozed_until, n.a.who AS acknowledged_by, coalesce(n.a.tm, acknowledged_at) AS acknowledged_at, nullif(n.g.who, '') AS assigned_to, coalesce(refused, 0) AS refused FROM items LEFT JOIN n USING (item_id)""")
def item_requests(spark, d):
    k = F.col("o_orderkey")
    who = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("user"), k % 5))
    log = D.table(spark, d, "orders").select((k % 8000).alias("item_id"), F.col("o_orderdate").alias("at"), who.alias("actor"), F.element_at(F.array(*map(F.lit, ("snooze", "acknowledge", "assign", "shout"))), (k % 4 + 1).cast("int")).alias("action"), (k % 100).alias("days"), who.alias("assignee"))
    return casework.worked_on(D.items(spark, d), log, "item_id").select("item_id", "snoozed_until", "acknowledged_by", "acknowledged_at", "assigned_to", "refused")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN 'ignored' WHEN c_custkey % 3 = 0 THEN 'registered' WHEN c_custkey % 4 = 0 THEN 'ignored' ELSE 'pending' END AS status, CASE WHEN c_custkey % 10 <> 9 AND c_custkey % 3 = 0 THEN c_custkey // 2 END AS account_id FROM customer""")
def account_discoveries(spark, d):
    """Two sightings an account, a statement's and a ledger's; some are registered, some ignored, some were ignored before."""
    c, k = D.table(spark, d, "customer"), F.col("c_custkey")
    kind, ident = F.when(k % 2 == 0, "statement").otherwise("ledger"), F.concat(F.lit("A"), k)
    seen = c.select(k, kind.alias("kind"), ident.alias("identifier"), F.lit("USD").alias("currency"), F.when(k % 10 == 9, "ignored").otherwise("pending").alias("status"))
    some = c.where("c_custkey % 3 = 0")
    registered = some.select(F.floor(k / 2).alias("account_id"), F.when(k % 2 == 0, F.concat(F.lit(" "), ident)).otherwise("none").alias("statement_account"), F.when(k % 2 == 1, ident).otherwise("none").alias("ledger_account"), F.lit("usd ").alias("currency"))
    return casework.discoveries(seen, registered, seen.where("c_custkey % 4 = 0")).select("c_custkey", "status", "account_id")
