"""Candidate pairs: a token join on references, a range join on amounts, and the tiers that judge both.

Rows on both sides carry ``session_id`` and ``row_number``; pairs never cross sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from tallyloom.functions import dates, text
from tallyloom.operators import tiers as T
from tallyloom.operators.store import written
from tallyloom.operators.tolerance import DEFAULT, OfRows, Tolerance, is_asked, number, window

KEYS = ["session_id", "l_row", "r_row"]


def _left(left: DataFrame, tol: Tolerance | OfRows, wanted: set[str] | None, keyed: bool) -> DataFrame:
    """session_id, type (of the balancing row), l (struct of the wanted columns and the row's number) and its reference keys."""
    own = F.struct(*[c for c in left.columns if wanted is None or c in wanted], F.col("row_number").alias("_row"))
    keys = text.ref_keys([F.col("our_ref")], [F.col("booking_text_1"), F.col("booking_text_2")], tol.at(F.col).min_ref_len) if keyed else F.array().cast("array<string>")
    return left.select("session_id", T.mirrored(F.col("sign")).alias("type"), own.alias("l"), keys.alias("l_keys"))


def _right(right: DataFrame, tol: Tolerance | OfRows, wanted: set[str] | None, keyed: bool) -> DataFrame:
    own = F.struct(*[c for c in right.columns if wanted is None or c in wanted], F.col("row_number").alias("_row"))
    keys = text.ref_keys([F.col("trn_ref"), F.col("external_ref")], [F.col("narration")], tol.at(F.col).min_ref_len) if keyed else F.array().cast("array<string>")
    return right.select("session_id", "type", own.alias("r"), keys.alias("r_keys"))


_ON = ["session_id", "type"]


def _by_key(l: DataFrame, r: DataFrame) -> DataFrame:
    """session_id, l, r of rows that share a key. A pair is kept where the first key that both have is met, so it is found once."""
    # an outer explode, as the optimiser guards a plain one by filters that compute the keys again
    both = l.withColumn("key", F.explode_outer("l_keys")).join(r.withColumn("key", F.explode_outer("r_keys")), [*_ON, "key"])
    return both.where(F.get(F.array_intersect("l_keys", "r_keys"), F.lit(0)) == F.col("key")).select("session_id", "l", "r")


def _by_amount(l: DataFrame, r: DataFrame, tol: Tolerance | OfRows, days: int | None = None) -> DataFrame:
    """session_id, l, r of rows without a common key whose amounts lie in the left one's window, and whose dates are at most ``days`` apart if that is given.

    Amounts fall into bins at least as wide as the window: equal ones for an absolute tolerance, growing ones for a
    percentage. The left row looks into its bin and the two next to it, so the join is an equi-join with a filter.
    """
    at_l, at_r = (tol.at(lambda c, side=side: F.col(side)[c]) for side in "lr")
    l = l.withColumn("bin", F.explode(F.array(*[amount_bin(F.col("l.amount"), at_l) + d for d in (-1, 0, 1)])))
    r = r.withColumn("bin", amount_bin(F.col("r.amount"), at_r))
    return _same_bin(l, r, days).where(_near(tol)).where(~F.arrays_overlap("l_keys", "r_keys")).select("session_id", "l", "r")


def _same_bin(l: DataFrame, r: DataFrame, days: int | None) -> DataFrame:
    """Rows of one bin. With ``days`` they also meet by spans of days, so that n equal amounts of as many days do not make n * n pairs."""
    if days is None:
        return l.join(r, [*_ON, "bin"])
    span = 2 * days + 1
    l = l.withColumn("span", F.explode(F.array_distinct(F.array(*[F.floor((_day(F.col("l.value_date")) + d) / span) for d in (-days, days)]))))
    r = r.withColumn("span", F.floor(_day(F.col("r.value_date")) / span))
    return l.join(r, [*_ON, "bin", "span"]).where(_close(days))


def _day(ymd: Column) -> Column:
    """Days from 1970; an integer that names no day is close to itself alone, far from all days."""
    return F.coalesce(F.unix_date(dates.to_date(ymd)).cast("long"), -(ymd.cast("long") + (1 << 32)) * (1 << 16))


def _close(days: int) -> Column:
    l, r = F.col("l.value_date"), F.col("r.value_date")
    return F.coalesce((l == r) | (dates.days_between(l, r) <= days), F.lit(False))


def _near(tol: Tolerance | OfRows) -> Column:
    return F.abs(F.col("r.amount") - F.col("l.amount")) <= window(F.col("l.amount"), tol.at(lambda c: F.col("l")[c]))


#: A bin is hot where its pairs are so many times its rows.
HOT = 32
#: Lengths of grams: a reference is looked up by the longest of these that it has.
GRAMS = (6, 3)


def _by_amount_with_reference(l: DataFrame, r: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    """The pairs of :func:`_by_amount` of which one row's reference may lie inside the other's texts; others may be left out.

    Where a bin holds few rows, all its pairs are returned. In a hot bin (n equal amounts) references are looked up by the
    rarest of their grams instead, so that it costs its rows and the pairs that hold a reference, not all n * n of them.
    """
    at_l, at_r = (tol.at(lambda c, side=side: F.col(side)[c]) for side in "lr")
    on = [*_ON, "bin"]
    lb = l.withColumn("bin", F.explode(F.array(*[amount_bin(F.col("l.amount"), at_l) + d for d in (-1, 0, 1)])))
    rb = r.withColumn("bin", amount_bin(F.col("r.amount"), at_r))
    size = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    hot = size(lb, "ln").join(size(rb, "rn"), on).where(F.col("ln").cast("double") * F.col("rn") > HOT * (F.col("ln") + F.col("rn")))
    hot = hot.select(on)
    fine = _near(tol) & ~F.arrays_overlap("l_keys", "r_keys")
    if not hot.count():
        return lb.join(rb, on).where(fine).select("session_id", "l", "r")
    hot = written(hot, "hot-bins")
    cold = lb.join(hot, on, "left_anti").join(rb, on).where(fine).select("session_id", "l", "r")
    lh, rh = lb.join(hot, on, "left_semi"), rb.join(hot, on, "left_semi")
    number_of = lambda side: F.col(f"{side}._row").alias(f"{side}_row")
    whole = lambda side, *fields: F.array(*[text.normalize_ref(F.col(f"{side}.{f}")) for f in fields])
    enough = lambda side, length: length >= tol.at(lambda c: F.col(side)[c]).min_ref_len
    bare = lambda f: text.normalize_ref(F.col(f"r.{f}"))
    # a reference of separators alone counts as a short one
    written_long = lambda f: F.when(enough("r", F.length(F.trim(text.text(F.col(f"r.{f}"))))), F.when(bare(f) == "", "-").otherwise(bare(f))).otherwise("")
    theirs = lh.select(*on, number_of("l"), F.explode(whole("l", "our_ref")).alias("needle"), "l").where(enough("l", F.length("needle"))).drop("l"), rh.select(*on, number_of("r"), whole("r", "narration", "external_ref", "trn_ref").alias("texts"))
    ours = rh.select(*on, number_of("r"), F.explode(F.array(written_long("trn_ref"), written_long("external_ref"))).alias("needle")), lh.select(*on, number_of("l"), whole("l", "booking_text_1", "booking_text_2").alias("texts"))
    found = _holding(*theirs, on, "l_row", "r_row").unionByName(_holding(*ours, on, "r_row", "l_row")).distinct()
    both = found.join(lh.withColumn("l_row", F.col("l._row")), [*on, "l_row"]).join(rh.withColumn("r_row", F.col("r._row")), [*on, "r_row"])
    return cold.unionByName(both.where(fine).select("session_id", "l", "r"))


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def _grams_of(n: int):
    return lambda c: _grams(c, n)  # Spark counts a lambda's parameters, so that it may not have a second one


def _holding(needles: DataFrame, texts: DataFrame, on: list[str], row: str, other: str) -> DataFrame:
    """on, row, other: needles and the rows some text of which may hold them. Needles shorter than all grams meet every row."""
    size = F.length("needle")
    found = needles.where((size < GRAMS[-1]) & (size > 0)).select(*on, row).join(texts.select(*on, other), on)
    for n, upto in zip(GRAMS, (None, *GRAMS)):
        own = needles.where((size >= n) & (F.lit(True) if upto is None else size < upto))
        near = texts.join(own.select(*on).distinct(), on, "left_semi")
        known = near.select(*on, other, F.explode(F.array_distinct(F.flatten(F.transform("texts", _grams_of(n))))).alias("g"))
        counts = known.groupBy(*on, "g").agg(F.count("*").alias("n"))
        grams = own.select(*on, row, "needle", F.explode(_grams(F.col("needle"), n)).alias("g"), F.size(_grams(F.col("needle"), n)).alias("grams"))
        rarest = grams.join(counts, [*on, "g"]).groupBy(*on, row, "needle", "grams").agg(F.min(F.struct("n", "g"))["g"].alias("g"), F.count("*").alias("met"))
        found = found.unionByName(rarest.where("met = grams").join(known, [*on, "g"]).select(*on, row, other))
    return found.select(*on, "l_row", "r_row")


def _by_rate(l: DataFrame, r: DataFrame, tol: Tolerance | OfRows, days: int | None = None) -> DataFrame:
    """Those that neither of the others finds, and whose amount lies within ``fx_bps`` of the left one times its ``rate``.

    The converted amounts fall into growing bins, as percentages do; rows without a rate have no such candidates.
    """
    share = lambda side: Tolerance(amount_abs=0.0, amount_pct=tol.at(lambda c: F.col(side)[c]).fx_bps / 100)
    there = F.col("l.amount") * F.col("l.rate")
    l = l.where((there != 0) & (number(share("l").amount_pct) > 0)).withColumn("there", there)
    l = l.withColumn("bin", F.explode(F.array(*[amount_bin(F.col("there"), share("l")) + d for d in (-1, 0, 1)])))
    r = r.withColumn("bin", amount_bin(F.col("r.amount"), share("r")))
    near = F.abs(F.col("r.amount") - F.col("there")) <= window(F.col("there"), share("l"))
    return _same_bin(l, r, days).where(near & ~_near(tol) & ~F.arrays_overlap("l_keys", "r_keys")).select("session_id", "l", "r")


def ref_token_join(left: DataFrame, right: DataFrame, tol: Tolerance = DEFAULT) -> DataFrame:
    """session_id, l_row, r_row of mirrored rows that share a reference key. The digit gate on free text keeps words out."""
    return _numbers(_by_key(_left(left, tol, set(), True), _right(right, tol, set(), True)))


def _numbers(pairs: DataFrame) -> DataFrame:
    return pairs.select("session_id", F.col("l._row").alias("l_row"), F.col("r._row").alias("r_row"))


def amount_bin(a: Column, tol: Tolerance) -> Column:
    """The bin of an amount; amounts in one another's window are in the same or in neighbouring bins."""
    least = F.greatest(number(tol.amount_abs), F.lit(1e-6))
    even = F.floor(a / (2 * least + 4e-9)).cast("long")
    if not is_asked(tol.amount_pct):
        return even
    step = F.log1p(F.greatest(number(tol.amount_pct) / 100 * 2, F.lit(1e-6)))
    below = least * 100 / F.nullif(number(tol.amount_pct), F.lit(0.0))  # below it the absolute tolerance is the wider one
    growing = F.when(F.abs(a) <= below, F.lit(0)).otherwise(F.ceil(F.log(F.abs(a) / below) / step)).cast("long")
    return F.when(tol.amount_pct > 0, growing).otherwise(even) if isinstance(tol.amount_pct, Column) else growing


def amount_window_join(left: DataFrame, right: DataFrame, tol: Tolerance = DEFAULT) -> DataFrame:
    """session_id, l_row, r_row of mirrored rows whose amounts lie in the left one's window."""
    return _numbers(_by_amount(_left(left, tol, {"amount"}, False), _right(right, tol, {"amount"}, False), tol))


def with_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """``pairs`` with both rows, or of them the ``wanted`` columns, as structs ``l`` and ``r``."""
    some = lambda df: F.struct(*[c for c in df.columns if wanted is None or c in wanted])
    l = left.select("session_id", F.col("row_number").alias("l_row"), some(left).alias("l"))
    r = right.select("session_id", F.col("row_number").alias("r_row"), some(right).alias("r"))
    return pairs.join(l, ["session_id", "l_row"]).join(r, ["session_id", "r_row"])


def sides(left: DataFrame, right: DataFrame, tiers: list[T.Tier] | T.OfRows, tol: Tolerance | OfRows = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Both sides as :func:`candidates` joins them: session_id, type, the columns that the tiers read, and the reference keys."""
    wanted = None if isinstance(tiers, T.OfRows) else T.columns(tiers) | {"amount", "our_ref", *tol.columns}
    left, right = (df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, NullType)}) for df in (left, right))  # Parquet has no such type
    return _left(left, tol, wanted, True), _right(right, tol, wanted, True)


def hot_sessions(l: DataFrame, r: DataFrame) -> DataFrame | None:
    """session_id of the sessions (of :func:`sides`) with a reference key so frequent that its pairs are many times its rows; None without any."""
    sizes = lambda df, keys, name: df.select(*_ON, F.explode(keys).alias("key")).groupBy(*_ON, "key").agg(F.count("*").alias(name))
    both = sizes(l, "l_keys", "ln").join(sizes(r, "r_keys", "rn"), [*_ON, "key"])
    hot = written(both.where(F.col("ln").cast("double") * F.col("rn") > HOT * (F.col("ln") + F.col("rn"))).select("session_id").distinct(), "hot-sessions")
    return hot if hot.count() else None


def candidates(
    left: DataFrame, right: DataFrame, tiers: list[T.Tier] | T.OfRows | None = None, tol: Tolerance | OfRows = DEFAULT, amounts: bool | str | None = None, keyed: tuple[DataFrame, DataFrame] | None = None, keys: bool = True
) -> DataFrame:
    """session_id, l_row, r_row, tier, auto_confirm, amount_diff, ref: every pair that some tier accepts, by its first one.

    Amounts are searched only if a tier can do without a reference (``amounts`` overrides that: "contained" searches them for
    tiers that all need a reference, which may then lie inside another without being a common key), converted ones if rows have a
    ``rate`` and an ``fx_bps`` above 0. Every pair is found once, so that nothing has to be made distinct, and rows travel with
    their pairs: those columns that the tiers read, or all of them where rows carry the tiers. ``keyed``: :func:`sides`, if known. ``keys``: False if no row has a reference.
    """
    tiers = T.default_tiers() if tiers is None else tiers
    by_rows = isinstance(tiers, T.OfRows)
    l, r = keyed or sides(left, right, tiers, tol)
    pairs = _by_key(l, r) if keys else None
    add = lambda more: more if pairs is None else pairs.unionByName(more)
    if amounts is None:
        amounts = by_rows or not T.all_gated_by_ref(tiers)
    if amounts:
        near = l.where("l.searches") if by_rows else l
        days = None if by_rows else T.days_apart(tiers)
        referred = not by_rows and any(T.needs_reference(t) for t in T.active(tiers))
        if amounts == "contained":
            pairs = add(_by_amount_with_reference(near, r, tol))
        else:
            pairs = add(_by_amount(near, r, tol, days))
            if days is not None and referred:  # a reference inside a text is looked for on any day
                pairs = pairs.unionByName(_by_amount_with_reference(near, r, tol).where(~_close(days)))
        if "rate" in left.columns and is_asked(tol.at(F.col).fx_bps):
            pairs = pairs.unionByName(_by_rate(near, r, tol, None if referred else days))
    at = tol.at(lambda c: F.col("l")[c])
    if by_rows:
        first = tiers.first(F.col("l"), F.col("r"), at, left.columns, right.columns)
    else:
        conditions = {str(c): (f"_c{i}", c) for i, c in enumerate({str(c): c for t in T.active(tiers) for c in t.conditions}.values())}
        pairs = pairs.withColumns({name: T.condition(c, F.col("l"), F.col("r"), at) for name, c in conditions.values()})  # each once, however many tiers ask it
        first = T.first_tier(tiers, F.col("l"), F.col("r"), at, lambda c: F.col(conditions[str(c)][0]))
    rows = pairs.withColumn("t", F.explode_outer(F.array(first))).where("t is not null")  # judged once: no filter is pushed below an explode
    diff = F.col("r.amount") - F.col("l.amount")
    return rows.select("session_id", F.col("l._row").alias("l_row"), F.col("r._row").alias("r_row"), "t.tier", "t.auto_confirm", diff.alias("amount_diff"), F.col("l.our_ref").alias("ref"))


def equal_rows(left: DataFrame, right: DataFrame, tiers: list[T.Tier] | None = None, tol: Tolerance = DEFAULT) -> DataFrame | None:
    """The candidates that a greedy pass takes among rows of equal session, type, amount and date without references.

    All rows of such a block are candidates of one another at the first tier without a reference, and no other candidate of
    theirs comes before these, so the pass takes the first left with the first right row, the second with the second, and so
    on. Rows count only if no row in their amount window has a reference. None where the tiers are ordered otherwise.
    """
    tiers = T.default_tiers() if tiers is None else tiers
    free = [t for t in T.active(tiers) if not any(c.op in ("symmetric_in_narration", "in_other_narration") for c in t.conditions)]
    if not free or free[0].number > min(t.number for t in free) or tol.amount_abs < 0:
        return None
    kinds = {(c.field, c.op) for c in free[0].conditions}
    amount = {("amount", "equal_within_tol"), ("amount", "exact")}
    if not {("sign", "mirror"), ("value_date", "equal")} <= kinds <= {("sign", "mirror"), ("value_date", "equal"), ("value_date", "within_days")} | amount or not kinds & amount:
        return None
    key = ["session_id", "type", "amount", "value_date"]
    long = lambda c: F.length(F.trim(text.text(F.col(c)))) >= tol.min_ref_len
    l = left.select(
        "session_id", T.mirrored(F.col("sign")).alias("type"), "amount", "value_date", F.col("row_number").alias("row"), F.col("our_ref").alias("ref"),
        (F.size(text.ref_keys([F.col("our_ref")], [F.col("booking_text_1"), F.col("booking_text_2")], tol.min_ref_len)) > 0).alias("keyed"),
        (F.length(text.normalize_ref(F.col("our_ref"))) >= tol.min_ref_len).alias("carries"), amount_bin(F.col("amount"), tol).alias("bin"),
    )
    r = right.select(
        "session_id", "type", "amount", "value_date", F.col("row_number").alias("row"),
        (F.size(text.ref_keys([F.col("trn_ref"), F.col("external_ref")], [F.col("narration")], tol.min_ref_len)) > 0).alias("keyed"),
        (long("trn_ref") | long("external_ref")).alias("carries"), amount_bin(F.col("amount"), tol).alias("bin"),
    )

    def plain(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        near = other.where("carries").select("session_id", "type", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])).alias("bin")).distinct()
        rows = rows.where("not keyed and not carries and value_date <> 0 and not isnan(amount)").join(near, ["session_id", "type", "bin"], "left_anti")
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("row"))).drop("keyed", "carries", "bin").withColumnRenamed("row", name)

    both = plain(l, r, "l_row").join(plain(r, l, "r_row"), [*key, "place"])
    return both.select(*KEYS, F.lit(free[0].number).alias("tier"), F.lit(free[0].auto_confirm).alias("auto_confirm"), F.lit(0.0).alias("amount_diff"), "ref")


def at_tier(left: DataFrame, right: DataFrame, number: int, tiers: list[T.Tier] | None = None, tol: Tolerance = DEFAULT) -> DataFrame:
    """The candidates that fall to one tier. Later tiers are not looked at, so tiers of references alone search no amounts."""
    tiers = T.active(T.default_tiers() if tiers is None else tiers)
    upto = max((i for i, t in enumerate(tiers, 1) if t.number == number), default=0)
    return candidates(left, right, tiers[:upto], tol).where(F.col("tier") == number)
