"""Amounts and signs from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONVENTIONS = ("positive_credit", "positive_debit", "sign_column", "two_columns")
CREDIT_WORDS, DEBIT_WORDS = ("CR", "C", "+", "CREDIT"), ("DR", "D", "-", "DEBIT")


def comma_decimal(c: Column) -> Column:
    """A statement's amount, whose decimal mark is a comma."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


#: Currency codes that may stand before or after a number; signs of currencies may always. Fixed values.
CURRENCY_CODES = ("GHS", "USD", "EUR", "GBP", "NGN", "KES", "XOF", "ZAR", "CHF", "JPY")
_MARK = rf"(?:\p{{Sc}}|{'|'.join(CURRENCY_CODES)})"
#: The forms of a whole number: point decimal with commas between groups, comma decimal with points between groups, and one mark or none.
_POINT, _COMMA = r"[0-9]{1,3}(?:,[0-9]{2,3})+\.[0-9]*", r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]*"
_PLAIN, _ONE_COMMA = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)", r"[0-9]*,[0-9]+|[0-9]+,"


def parse_amount(c: Column) -> Column:
    """A signed number, or null where the text is anything but one number: a date, letters or two numbers are no amount.

    Brackets or a sign in front are read; one currency mark on either side and blanks between digits go. The later of point
    and comma is decimal, a comma alone too.
    """
    t = F.regexp_replace(F.trim(c.cast("string")), r"[\s\u00a0\u202f]+", "")
    bracketed = t.rlike(r"^\(.+\)$")
    inner = F.when(bracketed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    shape = rf"^([+-]?){_MARK}?([+-]?)([0-9.,]+){_MARK}?$"
    number = F.regexp_extract(inner, shape, 3)
    minus = (F.regexp_extract(inner, shape, 1) == "-") != (F.regexp_extract(inner, shape, 2) == "-")
    plain = (
        F.when(number.rlike(rf"^(?:{_PLAIN})$"), number)
        .when(number.rlike(rf"^(?:{_POINT})$"), F.replace(number, F.lit(","), F.lit("")))
        .when(number.rlike(rf"^(?:{_COMMA})$"), F.translate(number, ",.", "."))
        .when(number.rlike(rf"^(?:{_ONE_COMMA})$"), F.translate(number, ",", "."))
    )
    once = (F.regexp_extract(inner, shape, 1) == "") | (F.regexp_extract(inner, shape, 2) == "")
    value = F.when(once, plain.try_cast("double"))
    return F.when(bracketed != minus, -value).otherwise(value)


def balance_text(c: Column) -> Column:
    """struct(sign, ccy, amount, date) of a displayed balance such as "C EUR 1,250.00 on 20260417", or null."""
    t = F.trim(c.cast("string"))
    words = F.split(t, r"\s+")
    at = lambda i: F.get(words, F.lit(i))
    fine = (F.size(words) == 5) & at(0).isin("C", "D") & at(1).rlike("^[A-Z]{3}$") & at(2).rlike(r"^[0-9,]+(\.[0-9]+)?$") & (at(3) == "on") & at(4).rlike("^[0-9]{8}$")
    return F.when(fine, F.struct(at(0).alias("sign"), at(1).alias("ccy"), F.replace(at(2), F.lit(","), F.lit("")).try_cast("double").alias("amount"), at(4).try_cast("int").alias("date")))


def signed(amount: Column, convention: str, sign: Column | None = None) -> tuple[Column, Column]:
    """(absolute amount, CR or DR or null); a zero is DR where positive amounts are credits."""
    if convention == "sign_column":
        word = F.upper(F.trim(sign.cast("string")))
        return F.abs(amount), F.when(word.isin(*CREDIT_WORDS), "CR").when(word.isin(*DEBIT_WORDS), "DR")
    credit = amount > 0 if convention == "positive_credit" else amount < 0
    return F.abs(amount), F.when(amount.isNotNull(), F.when(credit, "CR").otherwise("DR"))


def two_columns(paid_in: Column, withdrawn: Column) -> tuple[Column, Column]:
    """Money in is a credit; neither side with an amount is an error (nulls)."""
    i, w = F.coalesce(parse_amount(paid_in), F.lit(0.0)), F.coalesce(parse_amount(withdrawn), F.lit(0.0))
    amount = F.when(i != 0, F.abs(i)).when(w != 0, F.abs(w))
    return amount, F.when(i != 0, "CR").when(w != 0, "DR")


def flip_reversal(amount: Column, kind: Column) -> tuple[Column, Column]:
    """A negative debit is a credit and the other way round."""
    back = amount < 0
    return F.abs(amount), F.when(back & (kind == "DR"), "CR").when(back & (kind == "CR"), "DR").otherwise(kind)


def signed_display(amount: Column, sign: Column) -> Column:
    return F.concat(F.when(sign.isin("D", "DR"), "-").otherwise("+"), F.format_number(F.abs(amount), 2))
