"""Review decisions with their guards, approvals, anchors and certificates, as folds of decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ledger import signed

#: From which statuses an action may start, and the status that it sets.
ACTIONS = {
    "confirm": (("pending",), "confirmed"),
    "bulk_confirm": (("pending",), "confirmed"),
    "reject": (("pending", "confirmed"), "rejected"),
    "reopen": (("rejected",), "pending"),
    "request_approval": (("pending",), "pending_approval"),
    "approve": (("pending_approval",), "confirmed"),
    "return": (("pending_approval",), "pending"),
}
#: A certificate's steps: the status before and after each.
CERTIFICATE = {"prepare": ("draft", "prepared"), "review": ("prepared", "reviewed"), "sign": ("reviewed", "signed"), "send_back": ("prepared", "draft")}


def _status_fold(rows: DataFrame, log: DataFrame, key: str, start: str, step) -> DataFrame:
    """Each key's log (at, ...) folded in order: ``step(state, entry)`` gives the next (status, by, refused). One row per log entry."""
    entries = log.select(key, F.struct("at", *[c for c in log.columns if c not in (key, "at")]).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
    both = rows.join(entries, key)
    state = "struct<status:string,by:string,refused:string>"
    first = F.struct(F.col(start).cast("string").alias("status"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("refused"))

    def take(done: Column, e: Column) -> Column:
        return F.concat(done, F.array(step(F.element_at(done, -1), e).cast(state)))

    folded = F.aggregate("es", F.array(first.cast(state)), take)
    out = both.select(key, F.explode(F.arrays_zip(F.col("es").alias("e"), F.slice(folded, 2, F.size("es")).alias("s"))).alias("z"))
    return out.select(key, "z.e.*", "z.s.status", "z.s.refused")


def judged(assignments: DataFrame, log: DataFrame, sessions: DataFrame) -> DataFrame:
    """A decision log with its effects: key, at, actor, action, status after it, and why it was refused.

    assignments: key, session_id, tier, status; log: key, at, actor, action; sessions: session_id, status, locked_at. A closed or
    locked session takes no decision; bulk confirmation takes tier 1 alone; nobody approves their own request. An action that
    may not start from the status at its time is refused and changes nothing. The decisions on one assignment are few.
    """
    shut = F.col("s_status").eqNullSafe("closed") | F.col("locked_at").isNotNull()
    rows = assignments.select("key", "session_id", "tier", F.col("status").alias("status0"))
    rows = rows.join(sessions.select("session_id", F.col("status").alias("s_status"), "locked_at"), "session_id", "left").withColumn("shut", shut)
    log = log.join(rows.select("key", "tier", "shut"), "key").select("key", "at", "actor", "action", "tier", "shut")

    def step(state: Column, e: Column) -> Column:
        fits, after = F.lit(False), state["status"]
        for action, (froms, to) in ACTIONS.items():
            here = (e["action"] == action) & state["status"].isin(*froms)
            fits, after = fits | here, F.when(here, to).otherwise(after)
        why = (
            F.when(e["shut"], "session closed")
            .when((e["action"] == "bulk_confirm") & (e["tier"] != 1), "only tier 1 in bulk")
            .when(~fits, "wrong status")
            .when((e["action"] == "approve") & (e["actor"] == state["by"]), "own request")
        )
        by = F.when(e["action"] == "request_approval", e["actor"]).otherwise(state["by"])
        return F.struct(F.when(why.isNull(), after).otherwise(state["status"]).alias("status"), F.when(why.isNull(), by).otherwise(state["by"]).alias("by"), why.alias("refused"))

    return _status_fold(rows.select("key", "status0"), log, "key", "status0", step).select("key", "at", "actor", "action", "status", "refused")


def after(assignments: DataFrame, judgements: DataFrame) -> DataFrame:
    """``assignments`` with the status that their last granted decision left, who took it and when."""
    last = judgements.where("refused is null").groupBy("key").agg(F.max(F.struct("at", "status", "actor")).alias("d"))
    out = assignments.join(last, "key", "left")
    return out.withColumn("status", F.coalesce("d.status", "status")).withColumn("decided_by", F.col("d.actor")).withColumn("decided_at", F.col("d.at")).drop("d")


def manual(proposals: DataFrame, left: DataFrame, right: DataFrame, assignments: DataFrame) -> DataFrame:
    """proposals (id, session_id, l_rows, r_rows) with ``refused`` and ``amount_diff``: matches made by hand.

    One side must be a single row, every row must exist and be free. The difference is that of the sums.
    """
    single = (F.least(F.size("l_rows"), F.size("r_rows")) == 1)
    held = {at: assignments.where("status <> 'rejected'").select("session_id", F.col(f"{at}_row").alias("row_number")).distinct().withColumn("held", F.lit(True)) for at in "lr"}

    def looked_up(at: str, rows: DataFrame) -> DataFrame:
        each = proposals.select("id", "session_id", F.explode(F.array_distinct(f"{at}_rows")).alias("row_number"))
        found = each.join(rows.select("session_id", "row_number", "amount"), ["session_id", "row_number"], "left").join(held[at], ["session_id", "row_number"], "left")
        return found.groupBy("id").agg(F.sum("amount").alias(f"{at}_sum"), F.count_if(F.col("amount").isNull()).alias(f"{at}_gone"), F.count_if("held").alias(f"{at}_held"))

    rows = proposals.join(looked_up("l", left), "id", "left").join(looked_up("r", right), "id", "left")
    why = F.when(~single, "one side must be single").when(F.coalesce(F.col("l_gone") + F.col("r_gone"), F.lit(1)) > 0, "no such row").when(F.col("l_held") + F.col("r_held") > 0, "row is taken")
    return rows.select("id", "session_id", "l_rows", "r_rows", why.alias("refused"), F.round(F.col("r_sum") - F.col("l_sum"), 4).alias("amount_diff"))


def awaiting_approval(assignments: DataFrame, requests: DataFrame) -> DataFrame:
    """Assignments whose approval was asked for and not yet given: requests (key, requested_by, requested_at, reviewed_by)."""
    open_ = requests.where("reviewed_by is null").select("key", "requested_by", "requested_at")
    return assignments.where("status = 'pending_approval'").join(open_, "key")


def anchors(log: DataFrame) -> DataFrame:
    """The anchor chain of every account: log (account_id, at, event, amount, sign, closing, reason) with ``anchor`` and ``refused``.

    A seed sets the anchor to its signed amount and is refused where there is one; a delta moves it (to the file's closing, if
    it has one) and is refused where there is none; a reset clears it, and needs a reason of ten characters and an anchor.
    """
    entries = F.struct("at", "event", "amount", "sign", "closing", "reason")
    rows = log.select("account_id", entries.alias("e")).groupBy("account_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    state = "struct<anchor:double,refused:string>"

    def step(done: Column, e: Column) -> Column:
        was = F.element_at(done, -1)["anchor"]
        why = (
            F.when((e["event"] == "seed") & was.isNotNull(), "anchored already")
            .when((e["event"] != "seed") & was.isNull(), "not seeded")
            .when((e["event"] == "reset") & (F.length(F.trim(F.coalesce(e["reason"], F.lit("")))) < 10), "reason too short")
        )
        moved = F.when(e["event"] == "seed", F.round(signed(e["amount"], e["sign"]), 2)).when(e["event"] == "delta", F.coalesce(e["closing"], F.round(was + signed(e["amount"], e["sign"]), 2)))
        return F.concat(done, F.array(F.struct(F.when(why.isNull(), moved).otherwise(was).cast("double").alias("anchor"), why.alias("refused")).cast(state)))

    none = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(None).cast("string").alias("refused")).cast(state)
    folded = F.slice(F.aggregate("es", F.array(none), step), 2, F.size("es"))
    out = rows.select("account_id", F.explode(F.arrays_zip(F.col("es").alias("e"), folded.alias("s"))).alias("z"))
    return out.select("account_id", "z.e.at", "z.e.event", "z.s.anchor", "z.s.refused")


def certificates(drafts: DataFrame, log: DataFrame) -> DataFrame:
    """The steps of certificates: log (key, at, actor, action) with the status after each and why it was refused. A signed one never changes."""

    def step(state: Column, e: Column) -> Column:
        after, fits = state["status"], F.lit(False)
        for action, (before, to) in CERTIFICATE.items():
            here = (e["action"] == action) & (state["status"] == before)
            after, fits = F.when(here, to).otherwise(after), fits | here
        why = F.when(state["status"] == "signed", "signed and immutable").when(~fits, F.concat(F.lit("is "), state["status"]))
        return F.struct(F.when(why.isNull(), after).otherwise(state["status"]).alias("status"), e["actor"].alias("by"), why.alias("refused"))

    return _status_fold(drafts.select("key", F.lit("draft").alias("status0")), log.select("key", "at", "actor", "action"), "key", "status0", step)


def snapshot(figures: DataFrame) -> DataFrame:
    """The figures of a certificate as one JSON text, which later changes of the ledger do not touch."""
    rows = F.array_sort(F.collect_list(F.struct("metric", "key", "n", "amount")))  # a few metrics
    return figures.agg(F.to_json(rows).alias("snapshot"))


def locked(sessions: DataFrame, signed_: DataFrame) -> DataFrame:
    """Closed sessions of the account and period of a signed certificate (account_id, period_start, period_end, signed_at) are locked, first by the earliest."""
    day = F.col("created_at").cast("date")
    hits = sessions.where("status = 'closed'").join(signed_.withColumnRenamed("account_id", "a"), (F.col("account_id") == F.col("a")) & day.between(F.col("period_start"), F.col("period_end")))
    when = hits.groupBy("session_id").agg(F.min("signed_at").alias("signed_at"))
    return sessions.join(when, "session_id", "left").withColumn("locked_at", F.coalesce("locked_at", "signed_at")).drop("signed_at")


def runs_to_keep(runs: DataFrame, keep: int = 20) -> DataFrame:
    """The last runs of each job."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("run_id")))
    return runs.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
