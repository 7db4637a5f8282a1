"""Lists and counters behind the screens: sessions, accounts, areas, logs, decoys, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import dates, text
from tallyloom.operators.analytics import ACCOUNT, bucket, scoped
from tallyloom.operators.candidates import amount_bin
from tallyloom.operators.tolerance import Tolerance

STATUSES = ("pending", "confirmed", "rejected")


def _in_scope(sessions: DataFrame, accounts: DataFrame, areas: DataFrame | None) -> DataFrame:
    """Sessions with their account; with a scope only those of its areas, so none without an account."""
    return scoped(sessions.join(accounts.select("account_id", "label", "access_area"), "account_id", "left"), areas)


def session_list(sessions: DataFrame, accounts: DataFrame, profiles: DataFrame, assignments: DataFrame, *, areas: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The newest sessions with account, profile and the counts of their assignments by status."""
    newest = _in_scope(sessions, accounts, areas).join(profiles.select("profile_id", F.col("name").alias("profile")), "profile_id", "left")
    newest = newest.orderBy(F.desc("session_id")).limit(limit)
    counts = assignments.join(newest.select("session_id"), "session_id", "left_semi").groupBy("session_id").pivot("status", list(STATUSES)).count()
    return newest.join(counts, "session_id", "left").na.fill(0, list(STATUSES))


def counters(sessions: DataFrame, accounts: DataFrame, assignments: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row: assignments by status, sessions with pending ones, all sessions; of a scope, if there is one."""
    mine = _in_scope(sessions, accounts, areas).select("session_id")
    held = assignments.join(mine, "session_id", "left_semi")
    one = held.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.countDistinct(F.when(F.col("status") == "pending", F.col("session_id"))).alias("open_sessions"))
    return one.crossJoin(F.broadcast(mine.agg(F.count("*").alias("total_sessions"))))  # one row each


def account_status(accounts: DataFrame, sessions: DataFrame, left: DataFrame, right: DataFrame, assignments: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """One row per account: last session, rows of both sides, confirmed, match rate (of statement rows), open items by age, cleared, written off."""
    of = sessions.select("session_id", "account_id")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session_id").agg(F.count("*").alias("n")).join(of, "session_id").groupBy("account_id").agg(F.sum("n").alias(name))

    age = dates.age_days(F.col("opened_at"), as_of)
    there = items.withColumn("bucket", bucket(age, ACCOUNT, ">90")).withColumn("age", age)
    is_open = F.col("status") == "open"
    stock = there.groupBy("account_id").agg(
        F.count_if(is_open).alias("open_items"), F.max(F.when(is_open, F.col("age"))).alias("oldest_days"), *[F.count_if(is_open & (F.col("bucket") == b)).alias(n) for n, b in (("le7", "<=7"), ("le30", "<=30"), ("le90", "<=90"), ("gt90", ">90"))],
        F.count_if(F.col("status") == "cleared").alias("cleared"), F.count_if(F.col("status") == "written_off").alias("written_off"),
    )
    out = accounts.select("account_id").join(sessions.groupBy("account_id").agg(F.max("session_id").alias("last_session")), "account_id", "left")
    for part in (count(left, "statement_rows"), count(right, "ledger_rows"), count(assignments.where("status = 'confirmed'"), "confirmed"), stock):
        out = out.join(part, "account_id", "left")
    out = out.na.fill(0, [c for c in out.columns if c not in ("account_id", "last_session", "oldest_days")])
    return out.withColumn("match_rate", F.when(F.col("statement_rows") > 0, F.round(100.0 * F.col("confirmed") / F.col("statement_rows"), 1)).otherwise(0.0))


def match_rates(left: DataFrame, right: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per session four rates in percent that are not to be confused.

    of_decisions: confirmed among all assignments; of_statement: confirmed among statement rows; of_rows: distinct rows of both
    sides in any assignment among all rows; matched_statement: distinct statement rows in any assignment among these.
    """
    rows = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    held = assignments.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.countDistinct(F.when(F.col("l_row") > 0, F.col("l_row"))).alias("l_held"), F.countDistinct(F.when(F.col("r_row") > 0, F.col("r_row"))).alias("r_held")
    )
    out = rows(left, "l_rows").join(rows(right, "r_rows"), "session_id", "full_outer").join(held, "session_id", "full_outer").na.fill(0, ["l_rows", "r_rows", "n", "confirmed", "l_held", "r_held"])
    rate = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 1)).otherwise(0.0)
    c = F.col
    return out.select("session_id", rate(c("confirmed"), c("n")).alias("of_decisions"), rate(c("confirmed"), c("l_rows")).alias("of_statement"), rate(c("l_held") + c("r_held"), c("l_rows") + c("r_rows")).alias("of_rows"), rate(c("l_held"), c("l_rows")).alias("matched_statement"))


def audit_of(log: DataFrame, session: int, keys: list[str]) -> DataFrame:
    """A session's log in order, with the named values of its JSON details."""
    return log.where(F.col("session_id") == session).select("id", "action", "actor", "at", *[text.detail(F.col("details"), k).alias(k) for k in keys]).orderBy("id")


def area_usage(areas: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every access area with the number of its active accounts, zeros included, in order of names."""
    n = accounts.where("active and access_area is not null").groupBy(F.col("access_area").alias("name")).agg(F.count("*").alias("accounts_count"))
    return areas.join(n, "name", "left").na.fill(0, ["accounts_count"]).orderBy("name")


def profiles_with_account(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """Active profiles with a file pattern and the account they are bound to, if any."""
    bound = accounts.select("account_id", "ac_no", F.col("ccy").alias("bound_ccy"))
    return profiles.where("active and coalesce(filename_pattern, '') <> ''").join(bound, "account_id", "left")


def records_of_files(records: DataFrame, files: DataFrame, *, scheme: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Card records with a reference and their file's scheme and stage; optionally of one scheme, and of an inclusive range of settlement days."""
    rows = records.where("coalesce(scheme_ref, '') <> ''").join(files.select("file_id", "scheme", "stage", "settlement_date"), "file_id")
    if scheme is not None:
        rows = rows.where(F.col("scheme") == scheme)
    if since is not None:
        rows = rows.where(F.col("settlement_date") >= since)
    return rows if until is None else rows.where(F.col("settlement_date") <= until)


def decoys(left: DataFrame, items: DataFrame, limit: int = 5, seed: int = 7) -> DataFrame:
    """Statement debits and open ledger credits of an account with equal amounts whose references do not hold one another: pairs that must not match.

    Amounts meet in bins of the tolerance. For each statement row the first such item is taken; of these a seeded sample is shown.
    """
    tol = Tolerance(amount_abs=0.01)
    l = left.where("sign = 'D'").select("account_id", "session_id", "row_number", F.col("amount").alias("l_amount"), "our_ref")
    l = l.withColumn("bin", F.explode(F.array(*[amount_bin(F.col("l_amount"), tol) + k for k in (-1, 0, 1)])))
    r = items.where("side = 'ledger' and sign = 'CR'").select("account_id", "item_id", F.col("amount").alias("r_amount"), F.col("ref")).withColumn("bin", amount_bin(F.col("r_amount"), tol))
    rows = l.join(r, ["account_id", "bin"]).where((F.abs(F.col("r_amount") - F.col("l_amount")) < 0.01) & text.unlike(F.col("ref"), F.col("our_ref")))
    first = rows.groupBy("account_id", "session_id", "row_number").agg(F.min_by(F.struct("l_amount", "our_ref", "item_id", "ref"), "item_id").alias("d"))
    return sampled(first.select("account_id", "session_id", "row_number", "d.*"), ["session_id", "row_number"], limit, seed)


def sampled(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows in an order that the seed and the key decide alone, whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def exported(assignments: DataFrame, left: DataFrame, right: DataFrame, items: DataFrame) -> DataFrame:
    """Assignments with both sides' amount and reference; a side that a carried item stands for (row 0) is filled from the item."""
    l = left.where("row_number > 0").select("session_id", F.col("row_number").alias("l_row"), F.col("amount").alias("la"), F.col("our_ref").alias("lr"))
    r = right.where("row_number > 0").select("session_id", F.col("row_number").alias("r_row"), F.col("amount").alias("ra"), F.col("trn_ref").alias("rr"))
    i = items.select("item_id", F.col("side").alias("item_side"), F.col("amount").alias("ia"), F.col("ref").alias("ir"))
    rows = assignments.join(l, ["session_id", "l_row"], "left").join(r, ["session_id", "r_row"], "left").join(i, "item_id", "left")
    of = lambda own, item, side: F.coalesce(own, F.when(F.col("item_side") == side, item))
    return rows.select(
        "session_id", "l_row", "r_row", "tier", of(F.col("la"), F.col("ia"), "statement").alias("l_amount"), of(F.col("lr"), F.col("ir"), "statement").alias("l_ref"),
        of(F.col("ra"), F.col("ia"), "ledger").alias("r_amount"), of(F.col("rr"), F.col("ir"), "ledger").alias("r_ref"), F.col("item_id").isNotNull().alias("carried"),
    )


def reported(assignments: DataFrame) -> DataFrame:
    """The order of the matched report: tier, then the larger amounts first."""
    return assignments.orderBy("tier", F.desc("amount"), "l_row")


def by_team(items: DataFrame) -> DataFrame:
    """The order of the items' list: teams and categories by name with the nameless last, then the oldest."""
    return items.orderBy(F.asc_nulls_last("functional_group"), F.asc_nulls_last("category"), "opened_at", "item_id")


def paged(df: DataFrame, order: list, offset: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(a page, the number of all rows): two queries over the same rows."""
    from tallyloom.operators.analytics import page

    return page(df, order, offset, size), df.agg(F.count("*").alias("total"))


def write_offs(items: DataFrame, comments: DataFrame) -> DataFrame:
    """Written-off items by team: how many, their amount and how many notes they have."""
    notes = comments.groupBy("item_id").agg(F.count("*").alias("notes"))
    rows = items.where("status = 'written_off'").join(notes, "item_id", "left")
    return rows.groupBy("functional_group").agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"), F.coalesce(F.sum("notes"), F.lit(0)).cast("long").alias("notes"))
