"""Card numbers in text: found by the Luhn check, masked to first six and last four digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text that may hold a number: 13 digits in a row, or with single blanks or hyphens between them.
CANDIDATE = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12}"
#: A digit group that is no part of a masked number, and runs of them; possessive, so that long runs need no stack.
_GROUP = r"(?![0-9]{6}\*\*\*[0-9]{4})(?!(?<=[0-9]{6}\*\*\*)[0-9]{4}(?![0-9]))[0-9]++"
_RUN = rf"(?<![0-9]){_GROUP}(?:[ -]{_GROUP})*+"
LONGEST = 19
#: Column names that must not hold whole card numbers. Fixed values.
FORBIDDEN = ("pan", "card_number", "cardnumber", "primary_account_number", "cvv", "cvv2", "cvc", "track1", "track2", "pin", "pin_block")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_pan(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) >= 13) & (F.length(d) <= 19) & F.call_function("luhn_check", d)


def pans(c: Column) -> Column:
    """The distinct card numbers of a text, as written: 13 to 19 digits in a row, or in groups with single blanks or hyphens.

    Every sequence of whole groups is tried, so a number is found behind another number or a date.
    """

    def sequences(run: Column) -> Column:
        groups = F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0))
        at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(groups) - i + 1)), lambda n: F.regexp_replace(F.array_join(F.slice(groups, i, n), ""), "[ -]$", ""))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), at))

    runs = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_RUN), F.lit(0)), lambda r: F.length(digits(r)) >= 13)
    return F.array_distinct(F.filter(F.flatten(F.transform(runs, sequences)), is_pan))


def pans_of(c: Column, n: int) -> Column:
    """The distinct card numbers of ``n`` digits in a row, read from the left wherever digits stand; neighbouring groups are not joined."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[0-9]{{{n}}}"), F.lit(0)), is_pan))


def mask(c: Column) -> Column:
    d = digits(c)
    return F.concat(F.substring(d, 1, 6), F.lit("***"), F.right(d, F.lit(4)))


def redact(c: Column) -> Column:
    """Every card number of a text masked, longer ones first; nothing else changes, so redacting twice is redacting once."""
    longest = F.reverse(F.array_sort(F.transform(pans(c), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))))
    whole = lambda p: F.concat(F.lit("(?<![0-9])"), p, F.lit("(?![0-9])"))
    return F.aggregate(longest, c, lambda t, x: F.regexp_replace(t, whole(x["p"]), mask(x["p"])))


def split_masked(c: Column) -> tuple[Column, Column]:
    """(first six, last four) of a number that is masked already or whole."""
    return F.regexp_extract(c, r"^\s*([0-9]{6})", 1), F.regexp_extract(c, r"([0-9]{4})\s*$", 1)


def refuse(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` whose evaluation fails if one of ``columns`` holds a whole card number."""
    bad = [c for c in df.columns if c.lower() in FORBIDDEN]
    if bad:
        raise ValueError(f"columns that must not be stored: {', '.join(bad)}")
    for c in columns:
        df = df.withColumn(c, F.when(F.size(pans(F.col(c))) > 0, F.raise_error(F.lit(f"{c} holds a card number"))).otherwise(F.col(c)))
    return df
