"""One run over sessions: guards, settings of each account, carry-forward, tiers, splits, automatic rules, residue and a log entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ledger, resolve, rules, splits
from tallyloom.operators import tiers as T
from tallyloom.operators.store import scratch, written
from tallyloom.operators.tolerance import OfRows, of_accounts

ASSIGNMENT = ("session_id", "l_row", "r_row", "tier", "amount_diff", "reason", "status", "source", "decided_by", "split_group_id", "item_id")


@dataclass(frozen=True)
class Flags:
    """The optional stages of a run. Tiers always run."""

    carry_forward: bool = False
    splits: bool = False
    many_to_many: bool = False
    auto_rules: bool = True
    seed: bool = True


def guarded(sessions: DataFrame) -> DataFrame:
    """``sessions`` with ``refused``: closed and locked ones take no run, nor do those whose last run has not finished."""
    flying = F.col("started_at").isNotNull() & F.col("finished_at").isNull()
    return sessions.withColumn("refused", F.when(F.col("status") == "closed", "closed").when(F.col("locked_at").isNotNull(), "locked").when(flying, "in progress"))


def _free(rows: DataFrame, held: DataFrame, side: str) -> DataFrame:
    return resolve.unmatched(rows, held.where(F.col(f"{side}_row") > 0), side)


def _carried(items: DataFrame, left: DataFrame, right: DataFrame, of: DataFrame, tol: OfRows) -> DataFrame:
    """Assignments of tier 0: open items of the sessions' accounts and the free rows that clear them; the other side's row is 0."""
    empty = F.array().cast("array<string>")
    name = lambda at: F.struct("session_id", F.lit(at).alias("at"), F.col("row_number").alias("row"))
    l = left.select("account_id", *tol.columns, name("l").alias("row_number"), "amount", "sign", F.array("our_ref").alias("own_refs"), F.array("booking_text_1", "booking_text_2").alias("texts"), "value_date")
    r = right.select("account_id", *tol.columns, name("r").alias("row_number"), "amount", F.col("type").alias("sign"), F.array("trn_ref", "external_ref").alias("own_refs"), F.array("narration").alias("texts"), "value_date")
    prior = items.where("status = 'open'").join(of.select("account_id", *tol.columns).distinct(), "account_id")
    rows = l.unionByName(r).withColumn("own_refs", F.coalesce("own_refs", empty))
    claims = ledger.carry_forward(prior, rows, tol).select("item_id", "row_number.*")
    at = F.col("at") == "l"
    return claims.select("session_id", F.when(at, F.col("row")).otherwise(0).alias("l_row"), F.when(at, 0).otherwise(F.col("row")).alias("r_row"), F.lit(0).alias("tier"), F.lit(0.0).alias("amount_diff"),
                         F.lit("carried over from an open item").alias("reason"), F.lit("confirmed").alias("status"), F.lit("auto_carry").alias("source"), F.lit("auto").alias("decided_by"), F.lit(None).cast("string").alias("split_group_id"), "item_id")


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` in the columns of :data:`ASSIGNMENT`, nulls where it lacks one."""
    kinds = {"l_row": "long", "r_row": "long", "tier": "int", "amount_diff": "double", "session_id": "long", "item_id": "long"}
    at = lambda c: columns[c] if c in columns else F.col(c) if c in df.columns else F.lit(None)
    return df.select([at(c).cast(kinds.get(c, "string")).alias(c) for c in ASSIGNMENT])


def _matched(left: DataFrame, right: DataFrame, of: DataFrame, items: DataFrame | None, tol: OfRows, flags: Flags) -> DataFrame:
    """The new assignments; ``left`` and ``right`` are the free rows, which carry the settings and tiers of their session."""
    out = []
    if flags.carry_forward and items is not None:
        carried = written(_with(_carried(items, left, right, of, tol)), "run-carried")
        left, right = _free(left, carried, "l"), _free(right, carried, "r")
        out.append(carried)
    pairs = written(resolve.confirmed(resolve.assigned(left, right, T.OfRows(), tol)), "run-pairs")
    out.append(_with(pairs, reason=T.reason(F.col("tier"), F.col("amount_diff"), F.col("ref")), source=F.lit("engine")))
    left, right = _free(left, pairs, "l"), _free(right, pairs, "r")
    for wanted, find in ((flags.splits, _split), (flags.many_to_many, lambda l, r, t: splits.many_to_many(l, r, t))):
        if wanted:
            held = written(_with(splits.persisted(find(left, right, tol)), reason=F.lit("sums agree")), "run-splits")
            left, right = _free(left, held, "l"), _free(right, held, "r")
            out.append(held)
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def _split(left: DataFrame, right: DataFrame, tol: OfRows) -> DataFrame:
    one = written(splits.one_to_many(left, right, tol), "run-split")
    rest = resolve.unmatched(left, one.select("session_id", F.explode("l_rows").alias("l_row")), "l")
    return one.unionByName(splits.many_to_one(rest, right, tol, taken=one))


def _with_tiers(sessions: DataFrame, tiers: dict[int | str, list[T.Tier]]) -> DataFrame:
    """``sessions`` with their tiers as columns: those of the account, else of its kind, else the built-in ones of the kind.

    ``gated`` and ``free`` are the stages of ``tiers`` that can be resolved one after the other (``staged``), which holds for
    absolute tolerances alone; ``searches`` says whether some tier can do without a reference.
    """

    def row(key: str, own: list[T.Tier]) -> tuple:
        stages = T.staged(own)
        gated, free = stages if stages is not None else ([], [])
        return key, T.as_rows(own), T.as_rows(gated), T.as_rows(free), not T.all_gated_by_ref(own), stages is not None

    kinds = {"one_sided": T.default_tiers(two_sided=False), "": T.default_tiers(two_sided=True)} | {k: v for k, v in tiers.items() if isinstance(k, str) and v}
    rows = [row(f"account {k}", v) for k, v in tiers.items() if isinstance(k, int) and v] + [row(f"kind {k}", v) for k, v in kinds.items()]
    known = sessions.sparkSession.createDataFrame(rows, f"key string, tiers {T.ROWS}, gated {T.ROWS}, free {T.ROWS}, searches boolean, staged boolean")
    columns = known.columns[1:]
    at = lambda name: known.select(F.col("key").alias(f"{name}_key"), F.struct(*columns).alias(name))
    key = lambda what, c: F.concat(F.lit(f"{what} "), c)
    rows = sessions.join(at("own"), F.col("own_key") == key("account", F.col("account_id").cast("string")), "left")
    rows = rows.join(at("of_kind"), F.col("of_kind_key") == key("kind", F.col("kind")), "left").join(at("other"), F.col("other_key") == "kind ", "left")
    best = F.coalesce("own", "of_kind", "other")
    rows = rows.select(*sessions.columns, *[best[c].alias(c) for c in columns])
    return rows.withColumn("staged", F.col("staged") & (F.col("amount_tol_pct") <= 0) & (F.col("amount_tol_abs") >= 0))


def reconcile(
    left: DataFrame,
    right: DataFrame,
    sessions: DataFrame,
    *,
    settings: DataFrame | None = None,
    tiers: dict[int | str, list[T.Tier]] | None = None,
    existing: DataFrame | None = None,
    items: DataFrame | None = None,
    auto_rules: DataFrame | None = None,
    flags: Flags = Flags(),
) -> dict[str, DataFrame]:
    """assignments (the new ones), items (new open items), refused (sessions and why) and log (one entry per session).

    sessions: session_id, account_id, kind (two_sided or one_sided), status, locked_at, started_at, finished_at; settings: tolerances
    by account; tiers: by account id, or by kind for the others, else the built-in ones; existing: assignments whose rows are
    taken, so that a second run adds nothing; items: open items of earlier sessions. Automatic rules confirm what tiers left
    pending.

    Settings and tiers are columns that each row gets from its session, so one plan serves all accounts: the number of jobs does
    not grow with their number, nor with that of their different settings.
    """
    with scratch() as keep:
        spark = sessions.sparkSession
        judged = written(guarded(sessions), "run-sessions")
        spec = "account_id long, " + ", ".join(f"{c} double" for c in OfRows.columns)
        settings = spark.createDataFrame([], spec) if settings is None else settings
        ok = of_accounts(judged.where("refused is null").select("session_id", "account_id", "kind"), settings)
        ok = written(_with_tiers(ok, tiers or {}), "run-settings")
        taken = _with(existing) if existing is not None else _with(left.where("false").select("session_id"))
        own = lambda rows: rows.drop(*ok.columns[1:]).join(ok.drop("kind"), "session_id")
        tol = OfRows(rate="rate" in left.columns)
        found = _matched(own(_free(left, taken, "l")), own(_free(right, taken, "r")), ok, items, tol, flags)
        found = written(found, "run-found")

        if flags.auto_rules and auto_rules is not None:
            l = left.select("session_id", F.col("row_number").alias("l_row"), F.col("our_ref").alias("l_ref"), F.col("their_ref").alias("l_their_ref"), F.col("value_date").alias("l_date"))
            r = right.select("session_id", F.col("row_number").alias("r_row"), F.col("trn_ref").alias("r_ref"), F.col("value_date").alias("r_date"))
            pending = found.where("status = 'pending' and source = 'engine'").join(l, ["session_id", "l_row"]).join(r, ["session_id", "r_row"])
            hits = rules.auto_match(pending, auto_rules).where("rule is not null").select("session_id", "l_row", "r_row", "rule")
            rows = found.join(hits, ["session_id", "l_row", "r_row"], "left").withColumn("status", F.when(F.col("rule").isNotNull(), "confirmed").otherwise(F.col("status")))
            found = written(_with(rows.withColumn("decided_by", F.coalesce("decided_by", F.when(F.col("rule").isNotNull(), F.concat(F.lit("rule "), "rule"))))), "run-ruled")

        run = ok.select("session_id")
        seeded = None
        if flags.seed:
            held = found.unionByName(taken)
            seeded = written(ledger.seed(left.join(run, "session_id", "left_semi"), right.join(run, "session_id", "left_semi"), held, None), "run-items")
        counts = found.groupBy("session_id").agg(
            F.count_if(F.col("tier").between(1, 4)).alias("pairs"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("source") == "split").alias("split_rows"), F.count_if(F.col("tier") == 0).alias("carried"),
            F.count_if(F.startswith("decided_by", F.lit("rule"))).alias("by_rule"),
        )
        log = run.join(counts, "session_id", "left")
        if seeded is not None:
            log = log.join(seeded.groupBy("session_id").agg(F.count("*").alias("seeded")), "session_id", "left")
        log = log.na.fill(0).withColumn("action", F.lit("session_matched"))
        keep += [df for df in (judged, ok, found, seeded) if df is not None]  # what the result reads; the run's other tables go
    return {"assignments": found, "items": seeded, "refused": judged.where("refused is not null").select("session_id", "refused"), "log": log}
