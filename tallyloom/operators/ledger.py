"""The rolling ledger of open items: seeding, carry-forward, balances and their continuity."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, text
from tallyloom.operators import resolve
from tallyloom.operators.candidates import amount_bin
from tallyloom.operators.store import numbered, written
from tallyloom.operators.tolerance import DEFAULT, OfRows, Tolerance, amount_ok, window

#: What balances an open item of a sign: ledger items look for statement signs and the other way round.
COUNTER = {"C": "DR", "D": "CR", "CR": "D", "DR": "C"}
CREDIT = ("C", "CR")


def counter_sign(sign: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in COUNTER.items():
        out = F.when(sign == a, b).otherwise(out)
    return out


def signed(amount: Column, sign: Column) -> Column:
    return F.when(sign.isin(*CREDIT), amount).otherwise(-amount)


def seed(left: DataFrame, right: DataFrame, assignments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows of both sides without any assignment as open items; those that exist already are skipped."""
    l = resolve.unmatched(left, assignments, "l").where("row_number > 0")
    r = resolve.unmatched(right, assignments, "r").where("row_number > 0")
    l = l.select("session_id", F.lit("statement").alias("side"), "row_number", "value_date", "amount", "sign", F.col("our_ref").alias("ref"),
                 F.trim(F.concat_ws(" ", text.text(F.col("booking_text_1")), text.text(F.col("booking_text_2")))).alias("narration"))
    r = r.select("session_id", F.lit("ledger").alias("side"), "row_number", "value_date", "amount", F.col("type").alias("sign"), F.col("trn_ref").alias("ref"), "narration")
    items = l.unionByName(r).dropDuplicates(["session_id", "side", "row_number"])
    return items if existing is None else items.join(existing.select("session_id", "side", "row_number"), ["session_id", "side", "row_number"], "left_anti")


def carry_forward(items: DataFrame, rows: DataFrame, tol: Tolerance | OfRows = DEFAULT) -> DataFrame:
    """Open items cleared by free rows of the opposite side: item_id, row_number, phase.

    items: item_id, account_id, amount, sign, ref, value_date; rows: account_id, row_number, amount, sign, own_refs and
    texts (arrays), value_date. Phase 1 takes equal references within the amount tolerance, phase 2 equal amounts near
    in date for items with a reference. Claims are resolved one-to-one, items in order, each its first row. Both tables carry
    the account's settings if ``tol`` is that of rows.
    """
    own_tol = tol.at(F.col)
    key = text.normalize_ref(F.col("ref"))
    i = items.withColumn("key", key).where(F.length("key") >= own_tol.min_ref_len).withColumn("want", counter_sign(F.col("sign")))
    own = F.filter(F.transform("own_refs", text.normalize_ref), lambda t: F.length(t) >= 3)
    loose = F.filter(F.transform(F.flatten(F.transform("texts", lambda t: text.split_tokens(t))), text.normalize_ref), lambda t: (F.length(t) >= 3) & text.ref_like(t))
    r = rows.withColumn("tokens", F.array_distinct(F.concat(own, loose)))

    def pairs(i: DataFrame, r: DataFrame, on: Column) -> DataFrame:
        both = i.select("account_id", "item_id", "want", F.col("amount").alias("ia"), F.col("value_date").alias("iv"), "key", *tol.columns).alias("i")
        return both.join(r, on).select(
            F.col("i.account_id").alias("session_id"), F.col("item_id").alias("l_row"), F.col("row_number").alias("r_row"), F.lit(0).alias("tier"), F.lit(0.0).alias("amount_diff")
        )

    def claims(p: DataFrame) -> DataFrame:
        return resolve.greedy(p.distinct())

    r1 = r.select(F.col("account_id").alias("ra"), "row_number", F.col("amount").alias("rm"), F.col("sign").alias("rs"), F.explode("tokens").alias("token"))
    same = (F.col("i.account_id") == F.col("ra")) & (F.col("want") == F.col("rs")) & (F.col("key") == F.col("token"))
    first = claims(pairs(i, r1, same & amount_ok(F.col("rm"), F.col("ia"), own_tol))).withColumn("phase", F.lit(1))

    done = first.select(F.col("session_id").alias("account_id"), F.col("l_row").alias("item_id"))
    used = first.select(F.col("session_id").alias("account_id"), F.col("r_row").alias("row_number"))
    i2 = i.join(done, ["account_id", "item_id"], "left_anti")
    r2 = r.join(used, ["account_id", "row_number"], "left_anti")
    # equal bins for an absolute tolerance, growing ones for a percentage: an equi-join either way
    i2 = i2.withColumn("bin", F.explode(F.array(*[amount_bin(F.col("amount"), own_tol) + k for k in (-1, 0, 1)])))
    r2 = r2.select(F.col("account_id").alias("ra"), "row_number", F.col("amount").alias("rm"), F.col("sign").alias("rs"), F.col("value_date").alias("rv"), amount_bin(F.col("amount"), own_tol).alias("rb"))
    on = (F.col("i.account_id") == F.col("ra")) & (F.col("want") == F.col("rs")) & (F.col("i.bin") == F.col("rb"))
    cols = ["account_id", "item_id", "want", "bin", F.col("amount").alias("ia"), F.col("value_date").alias("iv"), *tol.columns]
    p2 = i2.select(*cols).alias("i").join(r2, on).where((F.abs(F.col("rm") - F.col("ia")) <= window(F.col("ia"), own_tol)) & dates.date_close(F.col("iv"), F.col("rv"), own_tol.days))
    p2 = p2.select(F.col("i.account_id").alias("session_id"), F.col("item_id").alias("l_row"), F.col("row_number").alias("r_row"), F.lit(0).alias("tier"), (F.col("rm") - F.col("ia")).alias("amount_diff"))
    second = claims(p2).withColumn("phase", F.lit(2))
    return first.unionByName(second).select(F.col("session_id").alias("account_id"), F.col("l_row").alias("item_id"), F.col("r_row").alias("row_number"), "phase")


def cleared(items: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with their new status, and the assignments that record the claims (the other side's row is 0)."""
    hit = claims.select("account_id", "item_id", F.col("row_number").alias("cleared_row"))
    after = items.join(hit, ["account_id", "item_id"], "left").withColumn("status", F.when(F.col("cleared_row").isNotNull(), "cleared").otherwise("open"))
    rows = items.join(hit, ["account_id", "item_id"])
    on_ledger = F.col("sign").isin("C", "D")  # a statement item is cleared by a ledger row
    records = rows.select(
        "account_id", "item_id", F.when(on_ledger, 0).otherwise(F.col("cleared_row")).alias("l_row"), F.when(on_ledger, F.col("cleared_row")).otherwise(0).alias("r_row"),
        F.lit(0).alias("tier"), F.lit(0.0).alias("amount_diff"), F.lit("confirmed").alias("status"), F.lit("auto_carry").alias("source"),
    )
    return after, records


def balance_check(rows: DataFrame, balances: DataFrame, keys: list[str]) -> DataFrame:
    """Opening plus signed rows against closing: delta and whether it is below a cent."""
    sums = rows.groupBy(keys).agg(F.sum(signed(F.col("amount"), F.col("sign"))).alias("net"))
    out = balances.join(sums, keys, "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    delta = F.round(F.col("opening") + F.col("net") - F.col("closing"), 4)
    return out.withColumn("delta", delta).withColumn("balanced", F.abs("delta") < 0.01)


def continuity(chain: DataFrame, tolerance: float | str = DEFAULT.continuity_abs, forced: str | None = None, parts: int | None = None) -> DataFrame:
    """chain: account_id, seq, opening, closing. Each file's opening against the closing of the last accepted file before it.

    A refused file leaves the anchor where it was, so the files after it are refused until one fits or is accepted by force
    (``forced``, a boolean column). The first file of an account has no anchor and is accepted. ``tolerance`` is a number or a
    column.

    Files lie in ``parts`` ranges of account and order, whatever an account's share of them. A range is judged from the anchor
    that the range before it ends with; at first it is guessed that its own first file fits. Ranges whose guess was wrong are
    judged again until none is: mostly once, as a chain that fits again forgets where it came from. What then holds at every
    border is the fold of the whole account.
    """
    within = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    files = chain.select(F.struct(*chain.columns).alias("row"), "account_id", "seq", F.col("opening").cast("double").alias("opening"), F.col("closing").cast("double").alias("closing"), within.cast("double").alias("tol"), force.alias("forced"))
    ranges = parts or max(8, chain.sparkSession.sparkContext.defaultParallelism)
    laid = written(files.repartitionByRange(ranges, "account_id", "seq").withColumn("part", F.spark_partition_id()), "chain-files")
    order = Window.partitionBy("account_id").orderBy("part")
    none = F.lit(None).cast("double")
    ends = written(laid.groupBy("account_id", "part").agg(F.count("*").alias("files")).select("account_id", "part", none.alias("anchor"), none.alias("ends"), F.lag("part").over(order).isNotNull().alias("todo")), "chain-ends")
    ends = _judged_ends(laid, ends, ends.select("account_id").join(ends.where("todo").select("account_id").distinct(), "account_id", "left_semi").distinct())
    while True:
        # a range begins with what the one before it ends with; where that is what it was judged from, it stands
        moved = ends.withColumn("begins", F.lag("ends").over(order)).withColumn("todo", ~F.col("begins").eqNullSafe(F.col("anchor")))
        moved = written(moved.withColumn("anchor", F.col("begins")).drop("begins"), "chain-ends")
        if moved.where("todo").isEmpty():
            break
        ends = _judged_ends(laid, moved, None)
    found = _laid_from(laid, moved).mapInArrow(_judge, laid.select("row").schema.add("anchor", "double").add("accepted", "boolean"))
    out = found.select("row.*", "anchor", "accepted")
    return out.select(*chain.columns, "anchor", F.round(F.col("opening") - F.col("anchor"), 4).alias("gap"), "accepted")


def _laid_from(laid: DataFrame, ends: DataFrame) -> DataFrame:
    """The files of the ranges in ``ends``, in order, with the anchor that each range begins with."""
    at = ends.select(F.col("account_id").alias("_a"), F.col("part").alias("_p"), "anchor")
    rows = laid.join(at, F.col("account_id").eqNullSafe(F.col("_a")) & (F.col("part") == F.col("_p")))
    return rows.repartition("account_id", "part").sortWithinPartitions("account_id", "part", "seq", "opening", "closing", "tol", "forced")


def _judged_ends(laid: DataFrame, ends: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """``ends`` with the anchors that its ranges end with: of the accounts given, or where ``todo`` says that they are to be judged."""
    todo = ends.where("todo") if accounts is None else ends.join(accounts, "account_id", "left_semi")
    judged = _laid_from(laid.drop("row"), todo).mapInArrow(_end, ends.select("account_id", "part").schema.add("now", "double"))
    judged = judged.select(F.col("account_id").alias("_a"), F.col("part").alias("_p"), "now", F.lit(True).alias("seen"))
    both = ends.join(judged, F.col("account_id").eqNullSafe(F.col("_a")) & (F.col("part") == F.col("_p")), "left")
    return written(both.select("account_id", "part", "anchor", F.when(F.col("seen"), F.col("now")).otherwise(F.col("ends")).alias("ends"), "todo"), "chain-ends")


def _fits(opening: float | None, anchor: float, tol: float | None) -> bool:
    """Whether the gap, rounded half up to four places, is within the tolerance."""
    if opening is None or tol is None:
        return False
    gap = abs(opening - anchor)
    if abs(gap - tol) > 1e-3 or gap != gap:
        return gap <= tol
    return float(Decimal(repr(gap)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) <= tol


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """Per batch the (account, part), the anchor before and the acceptance of each file; the fold goes on over batches."""
    at, anchor = None, None
    for batch in batches:
        keys, before, taken, after = list(zip(batch.column("account_id").to_pylist(), batch.column("part").to_pylist())), [], [], []
        begins, opening, closing, tol, forced = (batch.column(c).to_pylist() for c in ("anchor", "opening", "closing", "tol", "forced"))
        for i, key in enumerate(keys):
            if key != at:
                at, anchor = key, begins[i]
            ok = anchor is None or forced[i] or _fits(opening[i], anchor, tol[i])
            before.append(anchor)
            taken.append(ok)
            if ok:
                anchor = closing[i]
            after.append(anchor)
        yield batch, before, taken, after


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, before, taken, _ in _steps(batches):
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(before, pa.float64()), pa.array(taken, pa.bool_())], names=["row", "anchor", "accepted"])


def _end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor behind each range's last file."""
    ends: dict = {}
    kinds = None
    for batch, _, _, after in _steps(batches):
        kinds = [batch.schema.field(c).type for c in ("account_id", "part")]
        keys = list(zip(batch.column("account_id").to_pylist(), batch.column("part").to_pylist()))
        for i, key in enumerate(keys):
            if i + 1 == len(keys) or keys[i + 1] != key:
                ends[key] = after[i]  # a range that goes on in the next batch is put right there
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ends], kinds[0]), pa.array([k[1] for k in ends], kinds[1]), pa.array(list(ends.values()), pa.float64())], names=["account_id", "part", "now"])


def running_anchor(chain: DataFrame, net: str = "net") -> DataFrame:
    """The running balance of each account where files bring no closing of their own."""
    w = Window.partitionBy("account_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chain.withColumn("anchor", F.sum(net).over(w))


def seed_balance(proof: DataFrame) -> DataFrame:
    """The anchor that a first proof sets: signed sum and last date."""
    return proof.groupBy("account_id").agg(F.round(F.sum(signed(F.col("amount"), F.col("type"))), 2).alias("closing"), F.max("value_date").alias("anchor_date"))


def discovered(seen: DataFrame, known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Sightings of accounts that no registry knows."""
    return seen.join(known.select(keys), keys, "left_anti").groupBy(keys).agg(F.count("*").alias("sightings"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def self_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A one-sided ledger as two sides: debits as statement rows of sign D, credits as ledger rows, each numbered anew."""
    debit = numbered(rows.where("type = 'DR'"), "session_id", "row_number", "n")
    debit = debit.select("session_id", F.col("n").alias("row_number"), "value_date", "amount", F.lit("D").alias("sign"), F.col("trn_ref").alias("our_ref"),
                         F.lit("").alias("their_ref"), F.col("narration").alias("booking_text_1"), F.lit("").alias("booking_text_2"))
    credit = numbered(rows.where("type = 'CR'"), "session_id", "row_number", "n")
    return debit, credit.withColumn("row_number", F.col("n")).select(rows.columns)


def decided(items: DataFrame, log: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """``items`` after a decision log (key, action, at, actor, and the status it sets as ``to``): the last allowed decision wins.

    ``allowed`` names the statuses from which an action may start; the log may hold any number of decisions per item.
    """
    start = items.select(key, "status")
    ok = F.lit(False)
    for action, froms in allowed.items():
        ok = ok | ((F.col("action") == action) & F.col("status").isin(*froms))
    last = log.join(start, key).where(ok).groupBy(key).agg(F.max(F.struct("at", "to", "actor")).alias("d"))
    out = items.join(last, key, "left")
    return out.withColumn("status", F.coalesce("d.to", "status")).withColumn("decided_by", F.col("d.actor")).withColumn("decided_at", F.col("d.at")).drop("d")


def close_sessions(sessions: DataFrame, now: Column, hours: int) -> DataFrame:
    """Open sessions of an age in hours are closed; closed ones stay as they are."""
    old = F.unix_timestamp(now) - F.unix_timestamp("created_at") >= hours * 3600
    return sessions.withColumn("status", F.when((F.col("status") == "open") & old, "closed").otherwise(F.col("status")))


def close(sessions: DataFrame, now: Column, hours: int, left: DataFrame, right: DataFrame, assignments: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, new open items): what :func:`close_sessions` closes leaves its residue as open items. Closing again adds none."""
    after = close_sessions(sessions, now, hours)
    closing = after.where("status = 'closed'").select("session_id").join(sessions.where("status = 'open'").select("session_id"), "session_id", "left_semi")
    mine = lambda df: df.join(closing, "session_id", "left_semi")
    return after, seed(mine(left), mine(right), assignments, items)


def manual_clearing(items: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (item_id, side, row_number) with ``refused``: an item is cleared by a row of the opposite side, once, while it is open.

    Of several requests for one item that could be granted, the one with the smallest row is.
    """
    rows = requests.join(items.select("item_id", F.col("side").alias("item_side"), F.col("status").alias("item_status")), "item_id", "left")
    why = F.when(F.col("item_status").isNull(), "no such item").when(F.col("item_status") != "open", "not open").when(F.col("side") == F.col("item_side"), "same side")
    rows = rows.withColumn("refused", why)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("refused").isNotNull(), "row_number", "side"))
    again = F.col("refused").isNull() & (place > 1)
    return rows.withColumn("refused", F.when(again, "cleared already").otherwise(F.col("refused"))).drop("item_side", "item_status")
