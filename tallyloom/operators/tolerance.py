"""Tolerances: when two amounts count as equal, and the settings of each account."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Number = float | Column


@dataclass(frozen=True)
class Tolerance:
    """The settings of one run as numbers, or those of each row as columns (see :class:`OfRows`)."""

    amount_abs: Number = 0.01
    amount_pct: Number = 0.0
    days: int | Column = 1
    min_ref_len: int | Column = 6
    fx_bps: Number = 0.0
    continuity_abs: float = 0.01

    #: Columns of rows that hold settings.
    columns = ()

    def at(self, get: Callable[[str], Column]) -> Tolerance:
        """The settings where ``get`` yields the columns of a row."""
        return self


@dataclass(frozen=True)
class OfRows:
    """Settings that rows carry as columns, so that one plan serves accounts of any settings. ``rate``: rows have a rate."""

    rate: bool = False
    columns = ("amount_tol_abs", "amount_tol_pct", "date_tol_days", "min_ref_len", "fx_tol_bps")

    def at(self, get: Callable[[str], Column]) -> Tolerance:
        amount_abs, pct, days, ref_len, bps = map(get, self.columns)
        return Tolerance(amount_abs, pct, days.cast("int"), ref_len.cast("int"), bps if self.rate else 0.0)


DEFAULT = Tolerance()


def is_asked(x: Number) -> bool:
    """Whether a share may play a part; a plan with a number of 0 does without it."""
    return isinstance(x, Column) or x > 0


def _where_asked(x: Number, ok: Column) -> Column:
    return (x > 0) & ok if isinstance(x, Column) else ok


def amount_ok(left: Column, right: Column, tol: Tolerance = DEFAULT, rate: Column | None = None) -> Column:
    """Within the absolute tolerance, or within the percentage of the larger amount, or of the converted one in basis points."""
    diff = F.abs(right - left)
    ok = diff <= tol.amount_abs
    if is_asked(tol.amount_pct):
        ok = ok | _where_asked(tol.amount_pct, diff / F.greatest(F.abs(left), F.abs(right), F.lit(1.0)) * 100 <= tol.amount_pct)
    if is_asked(tol.fx_bps) and rate is not None:
        there = left * rate
        ok = ok | _where_asked(tol.fx_bps, F.coalesce(F.abs(right - there) <= F.abs(there) * tol.fx_bps / 10000, F.lit(False)))
    return ok


def number(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def window(left: Column, tol: Tolerance = DEFAULT) -> Column:
    """Half the width of the range in which a left amount looks for right ones."""
    return F.greatest(number(tol.amount_abs), F.abs(left) * tol.amount_pct / 100) + 1e-9


def of_accounts(accounts: DataFrame, settings: DataFrame, tol: Tolerance = DEFAULT) -> DataFrame:
    """``accounts`` (account_id) with their settings, the defaults where an account has none."""
    names = {"amount_tol_abs": tol.amount_abs, "amount_tol_pct": tol.amount_pct, "date_tol_days": tol.days, "min_ref_len": tol.min_ref_len, "fx_tol_bps": tol.fx_bps}
    rows = accounts.join(settings.select("account_id", *[F.col(c).alias(f"own_{c}") for c in names]), "account_id", "left")
    return rows.select(*accounts.columns, *[F.coalesce(f"own_{c}", F.lit(v)).alias(c) for c, v in names.items()])


def with_rate(rows: DataFrame, rates: DataFrame, *, date: str, ccy: str) -> DataFrame:
    """As-of join: to each row the latest rate of its currency on or before its date (rates: ccy, rate_date, rate).

    Rows and rates meet by currency and month: a month has the rates of its own days and the last one before it. In a month
    rates become validity ranges, so the join is an equi-join with a range condition, and a row meets a month's rates alone.
    """
    from pyspark.sql import Window

    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    keyed = rows.withColumn("_month", month(date))
    rates = rates.select(F.col("ccy").alias("_ccy"), F.col("rate_date").alias("_from"), "rate", month("rate_date").alias("_month"))
    wanted = keyed.select(F.col(ccy).alias("_ccy"), "_month").distinct()
    # both sides are one row per currency and month, or day at most
    earlier = wanted.join(rates.drop("_month"), "_ccy").where(F.col("_from") < F.col("_month")).groupBy("_ccy", "_month").agg(F.max_by(F.struct("_from", "rate"), "_from").alias("r"))
    of_month = rates.select("_ccy", "_month", "_from", "rate").unionByName(earlier.select("_ccy", "_month", "r._from", "r.rate"))
    until = F.lead("_from").over(Window.partitionBy("_ccy", "_month").orderBy("_from"))
    spans = of_month.withColumn("_until", until).withColumnRenamed("_month", "_of")
    on = (F.col(ccy) == F.col("_ccy")) & (F.col("_month") == F.col("_of")) & (F.col(date) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    return keyed.join(spans, on, "left").drop("_ccy", "_from", "_until", "_month", "_of")
