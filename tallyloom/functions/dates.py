"""Dates: eight-digit integers, statement dates, several text formats, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "MM/dd/yyyy")
FAR = 999  # days between dates of which one is invalid


def to_date(ymd: Column) -> Column:
    """A date from an integer yyyymmdd; null where it names no day."""
    return F.try_to_date(F.lpad(ymd.cast("string"), 8, "0"), "yyyyMMdd")


def to_int(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyyMMdd").cast("int"), F.lit(0))


def iso(ymd: Column) -> Column:
    return F.date_format(to_date(ymd), "yyyy-MM-dd")


def statement_date(yymmdd: Column) -> Column:
    """Six digits of this century as yyyymmdd, else 0."""
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.concat(F.lit("20"), yymmdd).cast("int")).otherwise(0)


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """yyyymmdd from text in the first format that fits (month before day comes last), or from a spreadsheet's day number; 0 if none does."""
    t = F.trim(c.cast("string"))
    serial = F.when(t.rlike(r"^[0-9]{5}(\.[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(F.try_to_number(F.regexp_extract(t, "^([0-9]{5})", 1), F.lit("99999"))).cast("int")))
    day = F.split_part(t, F.lit(" "), F.lit(1))
    return to_int(F.coalesce(serial, *[F.try_to_date(day, f) for f in formats]))


def days_between(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.datediff(to_date(a), to_date(b))), F.lit(FAR))


def date_close(a: Column, b: Column, days: Column | int) -> Column:
    """Equal, or both valid and within ``days``; an absent date is close to nothing."""
    there = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return there & ((a == b) | (days_between(a, b) <= days))


def age_days(opened: Column, as_of: Column, clamp: bool = True) -> Column:
    """Whole days; a future date is 0 days old, or negative where ``clamp`` is off."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(opened.cast("timestamp"))) / 86_400_000_000)
    return (F.greatest(F.lit(0), days) if clamp else days).cast("int")
