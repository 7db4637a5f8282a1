"""Delimited files described by a profile, compiled to a select over the file's lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import amounts, dates

#: Tasks of a scan, each of some thirty splits or files at most, whose counts are sent to every task; those of more are joined by shuffle.
FEW_TASKS = 2000


@dataclass(frozen=True)
class Profile:
    """columns: field (ref, value_date, booking_date, narration, amount, paid_in, withdrawn, sign, currency) -> header."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    delimiter: str = ","
    skip_rows: int = 0
    header_row: int = 0
    date_format: str | None = None
    sign_convention: str = "positive_credit"
    currency: str | None = None


#: Starting points for common layouts; a bank's own profile replaces them.
PRESETS = {
    "plain": Profile("plain", {"value_date": "Date", "ref": "Ref", "narration": "Memo", "amount": "Amount"}),
    "two columns": Profile("two columns", {"value_date": "Date", "ref": "Receipt", "narration": "Details", "paid_in": "Paid In", "withdrawn": "Withdrawn"}, sign_convention="two_columns"),
    "marked": Profile("marked", {"value_date": "Date", "ref": "Ref", "narration": "Memo", "amount": "Amount", "sign": "Dr/Cr"}, sign_convention="sign_column"),
    "wallet statement": Profile("wallet statement", {"value_date": "Completion Time", "ref": "Receipt No.", "narration": "Details", "paid_in": "Paid In", "withdrawn": "Withdrawn"}, sign_convention="two_columns"),
    "wallet transfers": Profile("wallet transfers", {"value_date": "Transaction Date", "ref": "Transaction ID", "narration": "Description", "amount": "Amount", "sign": "Type", "currency": "Currency"}, sign_convention="sign_column"),
    "card switch": Profile("card switch", {"value_date": "Local Date", "ref": "RRN", "narration": "Merchant", "amount": "Amount"}, sign_convention="positive_debit"),
    "piped ledger": Profile("piped ledger", {"value_date": "VALUE_DATE", "booking_date": "BOOKING_DATE", "ref": "TRN_REF", "narration": "NARRATIVE", "amount": "AMOUNT", "sign": "DRCR", "currency": "CCY"}, delimiter="|", sign_convention="sign_column"),
    "european": Profile("european", {"value_date": "Datum", "ref": "Referenz", "narration": "Text", "amount": "Betrag"}, delimiter=";", date_format="dd.MM.yyyy"),
}


def _record(d: str) -> str:
    """A record's pattern: a field is quoted if it begins with a quote that is closed; line breaks end only other fields."""
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{d}\r\n]*+|[^{d}\r\n]*+)'
    return rf"{field}(?:{d}{field})*+"


def _cells(line: Column, delimiter: str) -> Column:
    """A record's cells, trimmed and unquoted. Quoted cells keep their delimiters: cells are matched, not split."""
    cell = rf'(?:^|{delimiter})("[^"]*+(?:""[^"]*+)*+"|[^{delimiter}]*)'
    found = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)))


def _extra(got: DataFrame) -> DataFrame:
    """path, row_number, extra of rows with cells and their file's header. Where a name repeats, its first column counts."""
    keys = F.array_distinct("header")
    first = F.transform(keys, lambda k: F.coalesce(F.get("cells", F.array_position("header", k).cast("int") - 1), F.lit("")))
    return got.where(F.exists("cells", lambda c: c != "")).select("path", "row_number", F.map_from_arrays(keys, first).alias("extra"))


def _delimiter(profile: Profile) -> str:
    return {"|": r"\|", "\t": "\t"}.get(profile.delimiter, profile.delimiter)


def rows(files: DataFrame, profile: Profile) -> DataFrame:
    """path, text -> path, row_number (over all data rows that are not blank), extra (header -> cell).

    Cells may hold line breaks, so a file is read whole. Where the header repeats a name, as trailing delimiters repeat the blank
    one, the name's first column counts.
    """
    d = _delimiter(profile)
    lines = F.filter(F.regexp_extract_all("text", F.lit(_record(d)), F.lit(0)), lambda s: F.trim(s) != "")
    data = files.select("path", F.slice(lines, profile.skip_rows + profile.header_row + 1, F.size(lines)).alias("lines")).where(F.size("lines") > 0)
    # the header is taken before lines are exploded: else every line would carry its whole file along
    parted = data.select("path", _cells(F.get("lines", F.lit(0)), d).alias("header"), F.slice("lines", 2, F.size("lines")).alias("body"))
    named = parted.select("path", "header", F.posexplode("body").alias("i", "line"))
    return _extra(named.select("path", "header", _cells(F.col("line"), d).alias("cells"), (F.col("i") + 1).alias("row_number")))


def read_lines(spark: SparkSession, paths: str | list[str], profile: Profile, parts: bool = False) -> DataFrame:
    """What :func:`rows` gives, of files whose cells hold no line breaks: a large file is read by as many tasks as it has splits.

    A line's number is its place in its split and the lines of the splits before it, which are counted first; so no file is sorted,
    and none passes through one task. ``parts``: a folder is a file, whose parts follow one another by name, as exports leave it;
    its path is the folder's, and its first part holds the header. What is joined to the lines is a row for each split and file.
    """
    d = _delimiter(profile)
    part = F.col("_metadata.file_path")
    path = F.regexp_replace(part, "/[^/]*$", "") if parts else part
    lines = spark.read.text(paths).select(path.alias("path"), part.alias("part"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    lines = lines.where(F.trim("line") != "").withColumn("at", F.monotonically_increasing_id())  # one after the other within a split
    counts = lines.groupBy("path", "part", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("path", "part", "split", (before - F.col("first")).alias("shift"))
    few = lines.rdd.getNumPartitions() <= FEW_TASKS
    top = profile.skip_rows + profile.header_row
    placed = lines.join(F.broadcast(shift) if few else shift, ["path", "part", "split"]).select("path", (F.col("at") + F.col("shift") - top).cast("int").alias("row_number"), "line")
    header = placed.where("row_number = 0").select("path", _cells(F.col("line"), d).alias("header"))
    return _extra(placed.where("row_number > 0").withColumn("cells", _cells(F.col("line"), d)).join(F.broadcast(header) if few else header, "path"))


def load(files: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, rows that could not be read with the reason) of path, text. The profile's currency goes before the column's."""
    return typed(rows(files, profile), profile)


def typed(rows: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """:func:`load` for rows that :func:`rows` or :func:`read_lines` gave."""
    at = lambda f: F.element_at("extra", F.lit(profile.columns[f])) if f in profile.columns else F.lit("")
    if profile.sign_convention == "two_columns":
        amount, sign = amounts.two_columns(at("paid_in"), at("withdrawn"))
    else:
        amount, sign = amounts.signed(amounts.parse_amount(at("amount")), profile.sign_convention, at("sign"))
    formats = (profile.date_format,) if profile.date_format else dates.FORMATS
    value = dates.parse_date(at("value_date"), formats)
    booked = dates.parse_date(at("booking_date"), formats)
    ccy = F.upper(F.lit(profile.currency)) if profile.currency else F.upper(F.trim(at("currency")))
    out = rows.select(
        "path", "row_number", at("ref").alias("trn_ref"), at("ref").alias("external_ref"), value.alias("value_date"), F.when(booked != 0, booked).otherwise(value).alias("booking_date"),
        sign.alias("type"), at("narration").alias("narration"), amount.alias("amount"), ccy.alias("ccy"), "extra",
    )
    why = F.when(F.col("amount").isNull(), "amount").when(F.col("type").isNull(), "sign").when(F.col("value_date") == 0, "date")
    judged = out.withColumn("error", why)
    return judged.where("error is null").drop("error"), judged.where("error is not null").select("path", "row_number", "error", "extra")


def to_cards(loaded: DataFrame, pan: str, *, stage: str, file_id: int) -> DataFrame:
    """Card records of loaded rows: the number masked, rows without reference dropped."""
    from tallyloom.functions import pan as P

    number = F.element_at("extra", F.lit(pan))
    first, last = P.split_masked(number)
    return loaded.where("trn_ref <> ''").select(F.col("trn_ref").alias("scheme_ref"), F.lit(stage).alias("stage"), F.lit(file_id).cast("long").alias("file_id"), "amount", "ccy", first.alias("pan_first6"), last.alias("pan_last4"), F.lit("new").alias("recon_status"))
