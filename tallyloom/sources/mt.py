"""Customer statements in tagged fields (types 940 and 950), with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import amounts, dates

TYPES = ("940", "950")
#: Marks of a statement line: credit, debit and their reversals. Fixed values.
MARKS = ("C", "D", "RC", "RD")


def messages(files: DataFrame) -> DataFrame:
    """path, text -> path, type, bic, fields (array of ":tag:value" in order); other types than ``TYPES`` go.

    Every message of a file is read: from the second on, "#2" and so on is added to the path, which so names a message.
    """
    each = files.select("path", F.posexplode(F.filter(F.split("text", r"(?=\{1:)"), lambda m: F.trim(m) != "")).alias("i", "text"))
    files = each.select(F.when(F.col("i") == 0, F.col("path")).otherwise(F.concat("path", F.lit("#"), F.col("i") + 1)).alias("path"), "text")
    kind = F.regexp_extract("text", r"\{2:[IO]([0-9]{3})", 1)
    bic = F.coalesce(*[F.when(F.regexp_extract("text", p, 1) != "", F.regexp_extract("text", p, 1)) for p in (r"\{2:I[0-9]{3}([A-Z0-9]{8})", r"\{2:O[0-9]{3}[0-9]{10}([A-Z0-9]{8})")])
    body = F.regexp_extract("text", r"(?s)\{4:\s*(.*?)\r?\n-\}", 1)
    body = F.when(body != "", body).otherwise(F.regexp_replace("text", r"\r?\n-\}?\s*$", ""))
    fields = F.filter(F.split(F.trim(body), r"\r?\n(?=:[0-9]{2}[A-Z]?:)"), lambda f: f.rlike(r"^:[0-9]{2}[A-Z]?:"))
    return files.select("path", kind.alias("type"), bic.alias("bic"), fields.alias("fields")).where(F.col("type").isin(*TYPES))


def _value(tag: str) -> Column:
    """The first field of a tag pattern."""
    hits = F.filter("fields", lambda f: f.rlike(f"^:{tag}:"))
    return F.trim(F.regexp_replace(F.get(hits, F.lit(0)), "^:[0-9]{2}[A-Z]?:", ""))


def _balance(tag: str) -> Column:
    """Fixed widths: mark 1, date 6, currency 3, then the amount, with or without a decimal comma."""
    v = _value(tag)
    cut = lambda at, n: F.substring(v, at, n)
    amount = F.substring(v, F.lit(11), F.length(v))
    fine = cut(1, 1).isin("C", "D") & cut(2, 6).rlike("^[0-9]+$") & cut(8, 3).rlike("^[A-Z]{3}$") & amount.rlike("^[0-9]+,?[0-9]*$")
    return F.when(fine, F.struct(cut(1, 1).alias("sign"), dates.statement_date(cut(2, 6)).alias("date"), cut(8, 3).alias("ccy"), amounts.comma_decimal(amount).alias("amount")))


def _line(rows: DataFrame) -> DataFrame:
    """``rows`` (v, a statement line) with its parts by the field's public description, taken off from the left one by one.

    Date (6 digits), entry date (4 digits, optional), mark (up to 2 letters), funds code (a letter, optional), amount (digits
    around a comma), type (4), own reference; after a double slash the bank's reference, on further lines a supplement.
    """
    first = F.rtrim(F.split_part("v", F.lit("\n"), F.lit(1)))
    left, their = F.split_part(first, F.lit("//"), F.lit(1)), F.split_part(first, F.lit("//"), F.lit(2))
    # what is left after each part is one function of what was left before, so that the plan stays small wherever it is inlined
    dates_off = F.regexp_replace(left, "^[0-9]{6}(?:[0-9]{4})?", "")
    marks_off = F.regexp_replace(dates_off, "^R?[CD][A-Z]?", "")
    amount_off = F.regexp_replace(marks_off, "^[0-9]+,[0-9]*", "")
    parts = {
        "date": F.substring(left, 1, 6),
        "entry": F.regexp_extract(left, "^[0-9]{6}([0-9]{4})", 1),
        "mark": F.regexp_extract(dates_off, "^R?[CD]", 0),
        "amount": F.regexp_extract(marks_off, "^[0-9]+,[0-9]*", 0),
        "kind": F.substring(amount_off, 1, 4),
        "own": F.trim(F.substring(amount_off, F.lit(5), F.length(amount_off))),
        "their": F.trim(their),
        "supplement": F.regexp_replace("v", r"^[^\n]*\n?", ""),
    }
    rows = rows.withColumns(parts)
    c = F.col
    good = c("date").rlike("^[0-9]{6}$") & c("mark").isin(*MARKS) & (c("amount") != "") & c("kind").rlike("^[A-Z][A-Z0-9]{3}$") & (c("own") != "")
    return rows.withColumn("good", good)


def statements(messages: DataFrame) -> DataFrame:
    """One row per message: account, reference, number, currency, opening, closing, available and forward balances."""
    forward = F.transform(F.filter("fields", lambda f: f.rlike("^:65:")), lambda f: F.regexp_replace(f, "^:65:", ""))
    rows = messages.select("path", "type", "bic", _value("25").alias("account"), _value("20").alias("statement_ref"), _value("28C").alias("statement_number"),
                           _balance("60[FM]").alias("opening"), _balance("62[FM]").alias("closing"), _balance("64").alias("available"), forward.alias("forward"))
    return rows.withColumn("currency", F.coalesce("opening.ccy", "closing.ccy"))


def lines(messages: DataFrame, keep_errors: bool = False) -> DataFrame:
    """Statement rows. A line that does not parse keeps its row number; it is left out unless ``keep_errors``.

    A narrative belongs to the line right before it, if that line parsed.
    """
    rows = messages.select("path", F.posexplode("fields").alias("pos", "f"))
    order = Window.partitionBy("path").orderBy("pos")  # the fields of one message
    rows = rows.withColumn("tag", F.regexp_extract("f", "^:([0-9]{2}[A-Z]?):", 1)).withColumn("v", F.regexp_replace("f", "^:[0-9]{2}[A-Z]?:", ""))
    rows = rows.withColumn("next_tag", F.lead("tag").over(order)).withColumn("next_v", F.lead("v").over(order)).where("tag = '61'")
    rows, part = _line(rows), {c: F.col(c) for c in ("good", "date", "entry", "mark", "amount", "kind", "own", "their", "supplement")}
    joined = lambda c: F.trim(F.regexp_replace(c, r"\s*\r?\n\s*", " "))
    value = dates.statement_date(part["date"])
    entry = F.when(part["entry"] != "", F.floor(value / 10000).cast("int") * 10000 + part["entry"].try_cast("int")).otherwise(value)
    bad = ~part["good"]
    out = rows.select(
        "path", F.row_number().over(order).alias("row_number"), bad.alias("parse_error"), value.alias("value_date"), amounts.comma_decimal(part["amount"]).alias("amount"),
        F.right(part["mark"], F.lit(1)).alias("sign"), part["mark"].startswith("R").alias("reversed"), F.lit("Their").alias("origin"), F.lit("Other").alias("type"), F.lit("Unmatched").alias("status"),
        entry.alias("book_date"), part["own"].alias("our_ref"), part["their"].alias("their_ref"), joined(part["supplement"]).alias("booking_text_1"),
        F.when((F.col("next_tag") == "86") & ~bad, joined(F.col("next_v"))).otherwise("").alias("booking_text_2"), part["kind"].alias("entry_type"),
    )
    return out if keep_errors else out.where(~F.col("parse_error"))
