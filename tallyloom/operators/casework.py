"""What people do to cases and open items, as logs of requests applied to tables: patches, comments, snoozes, discoveries.

A log holds any number of requests for a key; each is accepted or refused by itself, and of the accepted ones the last counts, field
by field. So a log is summed up by key before it meets the table, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITIES = ("low", "normal", "high", "urgent")
LONGEST_COMMENT, SNOOZE_DAYS = 4000, (1, 90)


def _refusal(*reasons: tuple[Column, str]) -> Column:
    """The first reason that holds; null where none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in reasons])


def _last(field: str, at: str = "at") -> Column:
    """The last value that a request gave a field, as one that may be cleared to null: null where no request gave any."""
    return F.max(F.when(F.col(field).isNotNull(), F.struct(F.col(at).alias("at"), F.col(field).alias("value"))))["value"].alias(field)


def patched(cases: DataFrame, log: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(``cases`` with their assignee, due_date and priority after all patches, the refused patches with why).

    log: key, at, actor, assignee, due_date (yyyy-MM-dd as text), priority. A null field stays as it is; an empty assignee or due date clears
    it. A patch of nothing, of an unknown priority or of a day that is none is refused as a whole.
    """
    given = lambda c: F.col(c).isNotNull()
    day = F.try_to_date("due_date", "yyyy-MM-dd")
    why = _refusal(
        (~(given("assignee") | given("due_date") | given("priority")), "nothing to update"), (given("priority") & ~F.col("priority").isin(*PRIORITIES), "unknown priority"),
        (given("due_date") & (F.col("due_date") != "") & (day.isNull() | ~F.rlike("due_date", F.lit(r"^\d{4}-\d{2}-\d{2}$"))), "no date"),
    )
    known = log.join(cases.select(key), key, "left_semi").withColumn("refused", why)
    last = known.where("refused is null").groupBy(key).agg(*[_last(c) for c in ("assignee", "due_date", "priority")], F.max(F.struct("at", "actor"))["actor"].alias("updated_by"))
    rows = cases.alias("c").join(last.alias("n"), key, "left")
    after = lambda c, new: F.when(F.col(f"n.{c}").isNull(), F.col(f"c.{c}")).otherwise(new).alias(c)
    own = [F.col(f"c.{c}") for c in cases.columns if c not in ("assignee", "due_date", "priority", key)]
    cases = rows.select(key, *own, after("assignee", F.nullif(F.col("n.assignee"), F.lit(""))), after("due_date", F.try_to_date("n.due_date", "yyyy-MM-dd")), after("priority", F.col("n.priority")), "n.updated_by")
    return cases, known.where("refused is not null").select(*log.columns, "refused")


def commented(log: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """log: target_type, target_id, at, author, body -> these with the body trimmed, and ``refused`` (null: a comment that stays).

    ``targets``: the ids (target_id) of each type that takes comments. There is no way to change or delete one.
    """
    known = None
    for kind, ids in targets.items():
        part = ids.select(F.lit(kind).alias("target_type"), "target_id").distinct()
        known = part if known is None else known.unionByName(part)
    rows = log.withColumn("body", F.trim(F.coalesce("body", F.lit("")))).join(known.withColumn("known", F.lit(True)), ["target_type", "target_id"], "left")
    why = _refusal((~F.col("target_type").isin(*targets), "unknown type"), (F.col("body") == "", "empty"), (F.length("body") > LONGEST_COMMENT, "too long"), (F.col("known").isNull(), "no such target"))
    return rows.withColumn("refused", why).drop("known")


def worked_on(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """``items`` with snoozed_until, acknowledged_by, acknowledged_at and assigned_to after a log of requests, and how many were refused.

    log: key, at, actor, action (snooze, acknowledge, assign), days, assignee. Only open items take requests; a snooze is for 1 to 90
    days from its time; an empty assignee takes the assignment away.
    """
    action = lambda a: F.col("action") == a
    why = _refusal((F.col("status") != "open", "not open"), (~F.col("action").isin("snooze", "acknowledge", "assign"), "unknown action"), (action("snooze") & ~F.coalesce(F.col("days").between(*SNOOZE_DAYS), F.lit(False)), "days"))
    rows = log.join(items.select(key, "status"), key).withColumn("refused", why)
    ok = F.col("refused").isNull()
    last = lambda a, *c: F.max(F.when(ok & action(a), F.struct("at", *c)))
    summed = rows.groupBy(key).agg(last("snooze", "days").alias("s"), last("acknowledge", "actor").alias("a"), last("assign", "assignee").alias("g"), F.count_if(~ok).alias("refused"))
    own = [c for c in items.columns if c not in ("snoozed_until", "acknowledged_by", "acknowledged_at", "assigned_to")]
    before = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    until = F.timestamp_add("DAY", F.col("s.days").cast("int"), F.col("s.at"))
    return items.join(summed, key, "left").select(
        *own, F.coalesce(until, before("snoozed_until", "timestamp")).alias("snoozed_until"), F.coalesce("a.actor", before("acknowledged_by", "string")).alias("acknowledged_by"),
        F.coalesce("a.at", before("acknowledged_at", "timestamp")).alias("acknowledged_at"), F.when(F.col("g").isNull(), before("assigned_to", "string")).otherwise(F.nullif("g.assignee", F.lit(""))).alias("assigned_to"),
        F.coalesce("refused", F.lit(0)).cast("long").alias("refused"),
    )


def discoveries(seen: DataFrame, registered: DataFrame, ignored: DataFrame) -> DataFrame:
    """Sightings of unknown accounts (kind, identifier, currency, status) after registrations and refusals.

    registered: account_id, statement_account, ledger_account, currency; a registration resolves what is pending of both sides. ignored:
    kind, identifier, currency. What is resolved stays; a registration goes before a refusal.
    """
    side = lambda kind, c: registered.select(F.lit(kind).alias("kind"), F.trim(c).alias("identifier"), F.upper(F.trim("currency")).alias("currency"), "account_id")
    known = side("statement", "statement_account").unionByName(side("ledger", "ledger_account")).groupBy("kind", "identifier", "currency").agg(F.min("account_id").alias("account_id"))
    on = ["kind", "identifier", "currency"]
    rows = seen.join(known, on, "left").join(ignored.select(*on).distinct().withColumn("no", F.lit(True)), on, "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & F.col("account_id").isNotNull(), "registered").when(pending & F.col("no"), "ignored").otherwise(F.col("status"))
    return rows.withColumn("account_id", F.when(pending, F.col("account_id"))).withColumn("status", status).drop("no")
