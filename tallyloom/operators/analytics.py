"""Reports over sessions, assignments and open items. The day of the report is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates
from tallyloom.operators.ledger import CREDIT
from tallyloom.operators.store import written

DASHBOARD = (("0-1", 1), ("2-3", 3), ("4-7", 7), ("8-30", 30))
ACCOUNT = (("<=7", 7), ("<=30", 30), ("<=90", 90))
STOP_WORDS = ("THE", "AND", "FOR", "WITH", "FROM", "PAYMENT", "TRANSFER")


def bucket(age: Column, edges: tuple[tuple[str, int], ...], last: str) -> Column:
    """The first edge that the age does not pass; a negative age has no bucket."""
    out = F.when(age < 0, F.lit(None).cast("string"))
    for name, top in edges:
        out = out.when(age <= top, name)
    return out.otherwise(last)


def ageing_dashboard(items: DataFrame, as_of: Column) -> DataFrame:
    """Open items by age; ages are not clamped, so items from the future count in no named bucket (null)."""
    age = dates.age_days(F.col("opened_at"), as_of, clamp=False)
    return items.where("status = 'open'").groupBy(bucket(age, DASHBOARD, "31+").alias("bucket")).agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"))


def ageing_account(items: DataFrame, as_of: Column, by: list[str]) -> DataFrame:
    age = dates.age_days(F.col("opened_at"), as_of)
    return items.where("status = 'open'").groupBy(*by, bucket(age, ACCOUNT, ">90").alias("bucket")).agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"))


def account_rollup(items: DataFrame, as_of: Column) -> DataFrame:
    """One row per account: open items, amount, oldest age and a count for each bucket."""
    age = dates.age_days(F.col("opened_at"), as_of)
    rows = items.where("status = 'open'").withColumn("age", age).withColumn("bucket", bucket(age, ACCOUNT, ">90"))
    named = [("le7", "<=7"), ("le30", "<=30"), ("le90", "<=90"), ("gt90", ">90")]
    return rows.groupBy("account_id").agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"), F.max("age").alias("oldest"), *[F.count_if(F.col("bucket") == b).alias(n) for n, b in named])


def open_by(items: DataFrame, key: str) -> DataFrame:
    return items.where("status = 'open'").groupBy(key).agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"), F.min("opened_at").alias("oldest"), F.max("opened_at").alias("newest"))


def top_by_count(items: DataFrame, key: str, n: int) -> DataFrame:
    return open_by(items, key).orderBy(F.desc("items"), key).limit(n)


def tier1_rate(assignments: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Confirmed at tier 1 among all confirmed of the last days, in percent; null if there are none."""
    rows = assignments.where((F.col("status") == "confirmed") & (F.col("decided_at") >= as_of - F.make_interval(days=F.lit(days))))
    return rows.agg(F.round(100.0 * F.count_if(F.col("tier") == 1) / F.nullif(F.count("*"), F.lit(0)), 1).alias("tier1_rate"))


def kpis(assignments: DataFrame, items: DataFrame, rows_seen: DataFrame, as_of: Column, today: Column) -> DataFrame:
    """tier1_rate, row_rate, oldest_open, sla_breached: one row. rows_seen: n rows of the sessions of the period."""
    open_ = items.where("status = 'open'")
    one = tier1_rate(assignments, as_of)
    sums = rows_seen.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(items.agg(F.count("*").alias("left"))))
    rate = sums.select(F.round(100.0 * (F.col("n") - F.col("left")) / F.nullif("n", F.lit(0)), 1).alias("row_rate"))
    old = open_.agg(F.min("opened_at").alias("o")).select(dates.age_days(F.col("o"), as_of, clamp=False).alias("oldest_open"))
    late = assignments.agg(F.count_if((F.col("status") == "pending") & (F.col("due_date") < today)).alias("sla_breached"))
    return one.crossJoin(F.broadcast(rate)).crossJoin(F.broadcast(old)).crossJoin(F.broadcast(late))  # one row each


def case_load(assignments: DataFrame, today: Column) -> DataFrame:
    rows = assignments.where("status = 'pending'")
    return rows.groupBy(F.coalesce("assignee", F.lit("unassigned")).alias("assignee")).agg(
        F.count("*").alias("pending"), F.count_if(F.col("due_date") < today).alias("overdue"), F.count_if(F.col("priority").isin("high", "urgent")).alias("pressing")
    )


def trend(assignments: DataFrame, until: Column, days: int) -> DataFrame:
    """Per calendar day the decisions by status; days without any are zero. ``days`` is held between 1 and 90."""
    days = max(1, min(90, days))
    spark = assignments.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(until, days - 1), until)).alias("day"))
    counts = assignments.groupBy(F.col("decided_at").cast("date").alias("day")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "rejected", "pending")])
    rows = calendar.join(counts, "day", "left")
    filled = [F.coalesce(s, F.lit(0)).alias(s) for s in ("confirmed", "rejected", "pending")]
    return rows.select("day", *filled).withColumn("total", F.col("confirmed") + F.col("rejected") + F.col("pending"))


def break_analysis(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """Four counts in one table: category by status, account by status, month by status, tier by source."""
    coalesced = items.select(F.coalesce("category", F.lit("uncategorized")).alias("category"), F.col("account_id").cast("string").alias("account"), F.date_format("opened_at", "yyyy-MM").alias("month"), "status", "amount")
    sets = coalesced.groupingSets([["category", "status"], ["account", "status"], ["month", "status"]], "category", "account", "month", "status")
    one = sets.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    name = F.when(F.col("category").isNotNull(), "category").when(F.col("account").isNotNull(), "account").otherwise("month")
    one = one.select(name.alias("dimension"), F.coalesce("category", "account", "month").alias("key"), F.col("status").alias("part"), "n", "amount")
    two = assignments.groupBy("tier", "source").agg(F.count("*").alias("n"), F.round(F.sum("amount_diff"), 2).alias("amount"))
    return one.unionByName(two.select(F.lit("tier").alias("dimension"), F.col("tier").cast("string").alias("key"), F.col("source").alias("part"), "n", "amount"))


def decisions_by_user(assignments: DataFrame) -> DataFrame:
    rows = assignments.where("decided_at is not null")
    return rows.groupBy(F.coalesce("decided_by", F.lit("unknown")).alias("user"), F.col("decided_at").cast("date").alias("day")).agg(
        F.count("*").alias("decisions"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "rejected").alias("rejected")
    )


def match_patterns(decided: DataFrame, min_occurrences: int = 3, caps: tuple[int, ...] = (50, 30, 30, 30)) -> DataFrame:
    """How often decided rows of a token, reference prefix, user or module were confirmed; the best of each kind.

    decided: status, narration, trn_ref, user_id, module. Tokens are upper-case runs of a letter and three or more
    letters or digits, without stop words, once per row.
    """
    good = F.col("status") == "confirmed"
    rows = decided.where("status in ('confirmed', 'rejected')").withColumn("ok", good)
    words = F.regexp_extract_all(F.upper(F.coalesce("narration", F.lit(""))), F.lit("[A-Z][A-Z0-9]{3,}"), F.lit(0))
    kinds = {
        "token": F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))),
        "prefix": F.when(F.length("trn_ref") >= 4, F.array(F.substring("trn_ref", 1, 4))),
        "user": F.when(F.col("user_id") != "", F.array("user_id")),
        "module": F.when(F.col("module") != "", F.array("module")),
    }

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    long = rows.select("ok", F.explode(F.concat(*[tagged(k, v) for k, v in kinds.items()])).alias("p"))
    agg = long.groupBy("p.kind", "p.value").agg(F.count("*").alias("total"), F.count_if("ok").alias("confirmed")).where(F.col("total") >= min_occurrences)
    agg = agg.withColumn("rate", F.round(100.0 * F.col("confirmed") / F.col("total"), 1))
    agg, out = written(agg, "patterns"), None
    best = [F.desc(F.col("confirmed") / F.col("total")), F.desc("total"), F.asc("value")]
    for kind, cap in zip(kinds, caps):  # every task keeps its best ``cap`` of a kind; only these are ranked
        top = agg.where(F.col("kind") == kind).orderBy(*best).limit(cap)
        top = top.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*best)))
        out = top if out is None else out.unionByName(top)
    return out


def session_totals(left: DataFrame, right: DataFrame, assignments: DataFrame) -> DataFrame:
    """Credits and debits of each side of a session, of all rows and of those confirmed."""
    done = assignments.where("status = 'confirmed'")

    def side(rows: DataFrame, at: str, sign: str) -> DataFrame:
        held = done.select("session_id", F.col(f"{at}_row").alias("row_number"), F.lit(True).alias("done")).distinct()
        rows = rows.join(held, ["session_id", "row_number"], "left")
        credit, is_done = F.col(sign).isin(*CREDIT), F.coalesce("done", F.lit(False))
        total = lambda c: F.round(F.sum(F.when(c, F.col("amount")).otherwise(0.0)), 2)
        return rows.groupBy("session_id").agg(
            total(credit).alias("credits"), total(~credit).alias("debits"), total(credit & is_done).alias("credits_done"), total(~credit & is_done).alias("debits_done"), F.count("*").alias("rows")
        ).withColumn("side", F.lit(at))

    return side(left, "l", "sign").unionByName(side(right, "r", "type"))


def session_rates(assignments: DataFrame) -> DataFrame:
    """Per session: counts by status and the match rate (0.0 for a session without assignments)."""
    c = {s: F.count_if(F.col("status") == s) for s in ("confirmed", "pending", "rejected")}
    agg = assignments.groupBy("session_id").agg(*[v.alias(k) for k, v in c.items()])
    whole = F.col("confirmed") + F.col("pending") + F.col("rejected")
    return agg.withColumn("match_rate", F.when(whole > 0, F.round(100.0 * F.col("confirmed") / whole, 1)).otherwise(0.0))


def session_timeline(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Per session the items it opened and cleared, their net, and the running net of its account."""
    n = items.groupBy("session_id").agg(F.count("*").alias("seeded"), F.count_if(F.col("status") == "cleared").alias("cleared"))
    rows = sessions.join(n, "session_id", "left").select(*sessions.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seeded", "cleared")])
    rows = rows.withColumn("net_items", F.col("seeded") - F.col("cleared"))
    w = Window.partitionBy("account_id").orderBy("created_at", "session_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("net_items").over(w))


def certificate(items: DataFrame, assignments: DataFrame, sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """The figures of a period, as metric, key, n and amount rows.

    Sessions created in the period and their assignments by status; items opened by its end, by category and by team;
    the first session's opening and the last one's closing.
    """
    inside = sessions.where((F.col("created_at").cast("date") >= start) & (F.col("created_at").cast("date") <= end))
    open_ = items.where((F.col("status") == "open") & (F.col("opened_at").cast("date") <= end))
    part = lambda df, metric, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs("amount")), 2).alias("amount")).withColumn("metric", F.lit(metric))
    held = assignments.join(inside.select("session_id"), "session_id", "left_semi")
    out = part(open_, "category", F.col("category")).unionByName(part(open_, "team", F.col("functional_group"))).unionByName(part(held, "assignments", F.col("status")))
    total = open_.agg(F.count("*").alias("n"), F.round(F.sum(F.abs("amount")), 2).alias("amount")).select(F.lit("all").alias("key"), "n", "amount", F.lit("open").alias("metric"))
    n = inside.agg(F.count("*").alias("n")).select(F.lit("all").alias("key"), "n", F.lit(None).cast("double").alias("amount"), F.lit("sessions").alias("metric"))
    ends = inside.agg(F.min_by("opening", "session_id").alias("opening"), F.max_by("closing", "session_id").alias("closing"))
    edge = ends.select(F.explode(F.array(F.struct(F.lit("opening").alias("key"), F.col("opening").alias("amount")), F.struct(F.lit("closing").alias("key"), F.col("closing").alias("amount")))).alias("e"))
    return out.unionByName(total).unionByName(n).unionByName(edge.select("e.key", F.lit(None).cast("long").alias("n"), "e.amount", F.lit("balance").alias("metric")))


def daily_breaks(items: DataFrame, day: Column, local: str = "LCY") -> DataFrame:
    """Open items of a day in tabs: one for each foreign currency, one for each team in local currency."""
    rows = items.where((F.col("status") == "open") & (F.col("opened_at").cast("date") <= day))
    tab = F.when(F.coalesce("ccy", F.lit(local)) != local, F.col("ccy")).otherwise(F.coalesce("functional_group", F.lit("operations")))
    credit = F.col("sign").isin(*CREDIT)
    return rows.groupBy(tab.alias("tab")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(credit, F.col("amount")).otherwise(0.0)), 2).alias("cr"), F.round(F.sum(F.when(credit, 0.0).otherwise(F.col("amount"))), 2).alias("dr"),
        F.round(F.sum(F.when(credit, F.col("amount")).otherwise(-F.col("amount"))), 2).alias("net"),
    )


def sla_feed(items: DataFrame, now: Column, days: float, limit: int = 500, escalate: bool = False) -> DataFrame:
    """Open, not snoozed items of at least ``days`` (fractions count), oldest first; escalation doubles the age and leaves out what is acknowledged."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / 86_400_000_000.0
    rows = items.where((F.col("status") == "open") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)) & (age >= days * (2 if escalate else 1)))
    rows = rows.where(F.col("acknowledged_at").isNull()) if escalate else rows
    return rows.orderBy("opened_at", "item_id").limit(limit)


def timeline(*sources: DataFrame) -> DataFrame:
    """Events (item_id, at, what, detail) of several sources as one history, in order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("item_id", "at", "what")


def best_assignment(assignments: DataFrame, side: str) -> DataFrame:
    """For each row of a side the assignment to show: confirmed before pending before rejected, then the lower tier."""
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "pending", 1).otherwise(2)
    w = Window.partitionBy("session_id", f"{side}_row").orderBy(rank, "tier", "l_row", "r_row")
    return assignments.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def register(left: DataFrame, right: DataFrame, assignments: DataFrame) -> DataFrame:
    """All rows of both sides with the assignment to show."""
    def side(rows: DataFrame, at: str, sign: str, ref: str) -> DataFrame:
        best = best_assignment(assignments, at).select("session_id", F.col(f"{at}_row").alias("row_number"), "status", "tier")
        return rows.join(best, ["session_id", "row_number"], "left").select("session_id", F.lit(at).alias("side"), "row_number", "value_date", "amount", F.col(sign).alias("sign"), F.col(ref).alias("ref"), F.coalesce("status", F.lit("unmatched")).alias("status"), "tier")

    return side(left, "l", "sign", "our_ref").unionByName(side(right, "r", "type", "trn_ref"))


def latest_per(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))


def previous(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return df.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def scoped(df: DataFrame, areas: DataFrame | None, column: str = "access_area") -> DataFrame:
    """Rows of the given access areas; without a scope all rows, with one never those without an area."""
    return df if areas is None else df.join(areas.select(column), column, "left_semi")


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page under a total order; the size is held between 1 and 500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(500, size)))


def search(log: DataFrame, *, text: str | None = None, actor: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows that meet all given conditions: a text in details or action, an actor, an inclusive range of days."""
    if text:
        log = log.where(F.contains(F.lower("details"), F.lit(text.lower())) | F.contains(F.lower("action"), F.lit(text.lower())))
    if actor:
        log = log.where(F.col("actor") == actor)
    if since is not None:
        log = log.where(F.col("at") >= since)
    return log if until is None else log.where(F.col("at") < F.date_add(until, 1))


def facets(log: DataFrame) -> DataFrame:
    """Counts of every actor and every action."""
    sets = log.select(F.explode(F.array(F.struct(F.lit("actor").alias("facet"), F.col("actor").alias("value")), F.struct(F.lit("action").alias("facet"), F.col("action").alias("value")))).alias("f"))
    return sets.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
