"""One-to-one resolution of candidates, and what it leaves over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import blocks
from tallyloom.operators import candidates as C
from tallyloom.operators import tiers as T
from tallyloom.operators.components import components
from tallyloom.operators.store import written, written_together
from tallyloom.operators.tolerance import DEFAULT, OfRows, Tolerance

_L, _R = ["session_id", "l_row"], ["session_id", "r_row"]


def order() -> Column:
    """The strict order in which candidates are taken: tier, size of the difference, then rows."""
    return F.struct("tier", F.abs("amount_diff").alias("gap"), "l_row", "r_row")


def greedy(pairs: DataFrame) -> DataFrame:
    """The assignments that a sequential greedy pass in :func:`order` takes.

    Each round takes every pair that comes first at both of its rows, uncontested ones among them; no earlier pair can claim
    either, so the result is the sequential one. Pairs at claimed rows go; the contested rest is taken up by the next round.
    A round shuffles by left, right and left rows again, joins nothing and is written once. Once a round leaves more than half
    of the pairs, they form long chains (n equal rows of both sides need n rounds): :func:`_in_order` resolves what is left in
    one pass over each connected component.
    """
    open_, taken, before = pairs.withColumn("_o", order()), None, None
    by_l, by_r = Window.partitionBy(_L), Window.partitionBy(_R)
    while True:
        rows = open_.withColumn("_l", F.min("_o").over(by_l)).withColumn("_r", F.min("_o").over(by_r))
        rows = rows.withColumn("_first", (F.col("_o") == F.col("_l")) & (F.col("_o") == F.col("_r"))).drop("_l", "_r")
        rows = rows.withColumn("_used_r", F.max("_first").over(by_r)).withColumn("_used_l", F.max("_first").over(by_l))
        rows = written(rows.where("_first or not (_used_l or _used_r)"), "greedy-round")
        first = rows.where("_first").select(pairs.columns)
        taken = first if taken is None else taken.unionByName(first)
        open_ = rows.where("not _first").select(*pairs.columns, "_o")
        left, every = rows.agg(F.count_if(~F.col("_first")), F.count("*")).first()
        if not left:
            return taken
        if 2 * left > (every if before is None else before):
            return taken.unionByName(written(_in_order(open_).select(pairs.columns), "greedy-taken"))
        before = left


def _in_order(pairs: DataFrame) -> DataFrame:
    """The sequential pass itself, connected components of pairs side by side; only the claimed rows of one are kept."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used_l, used_r = None, set(), set()
        for batch in batches:
            keep = []
            for i, (c, l, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_c", "l_row", "r_row")))):
                if c != group:
                    group, used_l, used_r = c, set(), set()
                if l not in used_l and r not in used_r:
                    used_l.add(l)
                    used_r.add(r)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    pairs = written(pairs, "greedy-open")
    node = lambda side: F.struct("session_id", F.lit(side).alias("side"), F.col(f"{side}_row").alias("row"))
    groups = components(pairs.select(node("l").alias("a"), node("r").alias("b")), "a", "b")
    of = groups.where("node.side = 'l'").select(F.col("node.session_id").alias("session_id"), F.col("node.row").alias("l_row"), F.xxhash64("component").alias("_c"))
    grouped = pairs.join(of, _L).repartition("_c").sortWithinPartitions("_c", "session_id", "_o")
    return grouped.mapInArrow(take, grouped.schema)


def assigned(left: DataFrame, right: DataFrame, tiers: list[T.Tier] | T.OfRows | None = None, tol: Tolerance | OfRows = DEFAULT) -> DataFrame:
    """What :func:`greedy` takes of all candidates of two sides.

    Where all tiers that need a reference come first and the others read but amounts, dates and signs (as the built-in ones
    do), the former are resolved alone, from pairs with a common key or with a reference inside a text, and what is left over
    by blocks of equal rows, so that n equal amounts do not make n * n pairs. Other tiers are resolved together. Rows that carry their tiers say by ``staged`` which it is.
    """
    if isinstance(tiers, T.OfRows):
        one = _in_stages(left.where("staged"), right.where("staged"), T.OfRows("gated"), T.OfRows("free"), tol)
        return one.unionByName(greedy(C.candidates(left.where("not staged"), right.where("not staged"), tiers, tol)))
    tiers = T.default_tiers() if tiers is None else tiers
    stages = T.staged(tiers) if tol.amount_pct == 0 and tol.amount_abs >= 0 else None
    if stages is not None:
        return _in_stages(left, right, *stages, tol)
    settled = C.equal_rows(left, right, tiers, tol)
    if settled is None:
        return greedy(C.candidates(left, right, tiers, tol))
    settled = written(settled, "greedy-equal")
    rest = greedy(C.candidates(unmatched(left, settled, "l"), unmatched(right, settled, "r"), tiers, tol))
    return settled.unionByName(rest)


def _in_stages(left: DataFrame, right: DataFrame, gated: list[T.Tier] | T.OfRows, free: list[T.Tier] | T.OfRows, tol: Tolerance | OfRows) -> DataFrame:
    if gated and free and not _refers(left, right, tol):
        gated = None
    first = _by_reference(left, right, gated, tol, "contained" if free else False) if gated else None
    if not free:
        return first if first is not None else greedy(C.candidates(left, right, [], tol, amounts=False))
    if first is None:
        return blocks.resolved(left, right, free, tol)
    return first.unionByName(blocks.resolved(unmatched(left, first, "l"), unmatched(right, first, "r"), free, tol))


def _refers(left: DataFrame, right: DataFrame, tol: Tolerance | OfRows) -> bool:
    """Whether some row has a reference of its own, without which no tier that needs one holds."""
    least = tol.at(F.col).min_ref_len
    own = F.length(text.normalize_ref(F.col("our_ref"))) >= least
    theirs = [F.length(F.trim(text.text(F.col(c)))) >= least for c in ("trn_ref", "external_ref")]
    return not left.where(own).isEmpty() or not right.where(theirs[0] | theirs[1]).isEmpty()


def _by_reference(left: DataFrame, right: DataFrame, gated: list[T.Tier] | T.OfRows, tol: Tolerance | OfRows, amounts: str | bool) -> DataFrame:
    """What :func:`greedy` takes at tiers that need a reference.

    Keys are computed and written once. Sessions in which many rows of both sides share a key are resolved by blocks of rows alike in
    all that the tiers read, so that n payments under one reference do not make n * n pairs; all others by pairs of rows.
    """
    l, r = written_together(dict(zip(("keyed-l", "keyed-r"), C.sides(left, right, gated, tol))))
    hot = C.hot_sessions(l, r)
    if hot is None:
        return greedy(C.candidates(left, right, gated, tol, amounts, (l, r)))
    rest = greedy(C.candidates(left, right, gated, tol, amounts, tuple(side.join(hot, "session_id", "left_anti") for side in (l, r))))
    own = [side.join(hot, "session_id", "left_semi") for side in (left, right)]
    return rest.unionByName(blocks.resolved(*own, gated, tol, amounts))


def unmatched(rows: DataFrame, assignments: DataFrame, side: str) -> DataFrame:
    """The rows of one side ("l" or "r") that no assignment holds."""
    held = assignments.select("session_id", F.col(f"{side}_row").alias("row_number"))
    return rows.join(held, ["session_id", "row_number"], "left_anti")


def competing(pairs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each losing candidate with the assignment it lost to: that of its left row if this came first, else of its right row."""
    lost = pairs.join(assignments.select("session_id", "l_row", "r_row"), ["session_id", "l_row", "r_row"], "left_anti").withColumn("_o", order())
    won = assignments.withColumn("_o", order()).withColumn("w", F.struct("l_row", "r_row"))
    l = won.select("session_id", "l_row", F.col("w").alias("wl"), F.col("_o").alias("_lo"))
    r = won.select("session_id", "r_row", F.col("w").alias("wr"))
    rows = lost.join(l, _L, "left").join(r, _R, "left")
    winner = F.when(F.col("_lo") < F.col("_o"), F.col("wl")).otherwise(F.coalesce("wr", "wl"))
    return rows.select("session_id", "l_row", "r_row", "tier", "amount_diff", winner["l_row"].alias("winner_l"), winner["r_row"].alias("winner_r"))


def top_competing(rivals: DataFrame, k: int = 6) -> DataFrame:
    """At most ``k`` rivals of each assignment, in the order of candidates."""
    w = Window.partitionBy("session_id", "winner_l", "winner_r").orderBy("tier", F.abs("amount_diff"), "l_row", "r_row")
    return rivals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_rivals(left: DataFrame, right: DataFrame, tiers: list[T.Tier] | None = None, tol: Tolerance = DEFAULT, k: int = 6) -> DataFrame:
    """What :func:`top_competing` gives for all candidates of two sides and what :func:`greedy` takes of them.

    Where no row has a reference and the other tiers read but amounts, dates and signs, it comes from blocks of equal rows and
    no pairs are listed; else from the list of all pairs.
    """
    tiers = T.default_tiers() if tiers is None else tiers
    stages = T.staged(tiers) if tol.amount_pct == 0 and tol.amount_abs >= 0 else None
    if stages is not None and stages[1] and not _refers(left, right, tol):
        return blocks.rivals(left, right, stages[1], tol, k)
    pairs = written(C.candidates(left, right, tiers, tol), "rival-pairs")
    found = top_competing(competing(pairs, greedy(pairs)), k)
    return found.select("session_id", "winner_l", "winner_r", "place", "l_row", "r_row", "tier", "amount_diff")


def confirmed(assignments: DataFrame, actor: str = "auto") -> DataFrame:
    """``status`` and ``decided_by`` from the tier's flag."""
    auto = F.col("auto_confirm")
    return assignments.withColumn("status", F.when(auto, "confirmed").otherwise("pending")).withColumn("decided_by", F.when(auto, F.lit(actor)))


def free_rows(rows: DataFrame, assignments: DataFrame, side: str, ignore_rejected: bool = False) -> DataFrame:
    """Rows without an assignment; rejected ones still hold their rows unless ``ignore_rejected``."""
    held = assignments.where("status <> 'rejected'") if ignore_rejected else assignments
    return unmatched(rows, held, side)


def engine_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two sets of matches side by side: agree, tier_changed, only_old, only_new."""
    key = ["session_id", "l_row", "r_row"]
    rows = old.select(*key, F.col("tier").alias("old_tier")).join(new.select(*key, F.col("tier").alias("new_tier")), key, "full_outer")
    verdict = (
        F.when(F.col("new_tier").isNull(), "only_old").when(F.col("old_tier").isNull(), "only_new").when(F.col("old_tier") == F.col("new_tier"), "agree").otherwise("tier_changed")
    )
    return rows.withColumn("verdict", verdict)
