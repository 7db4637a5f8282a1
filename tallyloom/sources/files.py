"""Files as rows: reading, decoding, duplicates, pairing, routing, triage."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What Windows-1252 puts where ISO-8859-1 has control characters.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
#: Whole files that a Python worker is given in one batch.
AT_ONCE = 200
XLSX_MAGIC = b"PK\x03\x04"


def load(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, content, sha256 of all files below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.load(path).select("path", "content")
    return rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("sha256", F.sha2("content", 256))


def few_at_once(files: DataFrame) -> DataFrame:
    """``files``, of which at most ``AT_ONCE`` come to a Python worker in one batch; Spark's 10,000 whole files take several times the memory.

    Sets the session's Arrow batches to that many rows if they are larger.
    """
    conf, name = files.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= AT_ONCE:
        conf.set(name, str(AT_ONCE))
    return files


def decoded(content: Column) -> Column:
    """UTF-8 (with or without its mark) where that is valid, else Windows-1252."""
    plain = F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252)
    text = F.when(F.call_function("is_valid_utf8", F.call_function("string", content)), F.decode(content, "UTF-8")).otherwise(plain)
    return F.regexp_replace(text, "^﻿", "")


def is_xlsx(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(XLSX_MAGIC)


def new_files(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """One file of each content that has not been taken in before."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    return files.join(ingested.select("sha256"), "sha256", "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def paired(left: DataFrame, right: DataFrame, key: str = "account") -> DataFrame:
    """The n-th file by name of each account on one side with the n-th on the other; leftovers have no partner."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("name"))
    l = left.select(key, nth.alias("n"), F.col("name").alias("l_name"))
    r = right.select(key, nth.alias("n"), F.col("name").alias("r_name"))
    status = F.when(F.col("l_name").isNull() | F.col("r_name").isNull(), "no_partner").otherwise("paired")
    return l.join(r, [key, "n"], "full_outer").withColumn("status", status)


def routed(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """The profile whose pattern alone fits the name, case aside; null if none or several do."""
    fits = [F.when(F.lower("name").rlike(_regex(g)), F.lit(p)) for p, g in globs.items()]
    found = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return files.withColumn("profile", F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def _regex(glob: str) -> str:
    return "^" + re.sub(r"^\(\?s:|\)\\[zZ]$", "", fnmatch.translate(glob.lower())) + "$"


def account_by_digits(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each file with the registered ledger account that is its name's first fitting run of eight or more digits."""
    runs = files.select("name", F.posexplode(F.regexp_extract_all("name", F.lit("[0-9]{8,}"), F.lit(0))).alias("i", "ledger_account"))
    hits = runs.join(accounts.select("ledger_account", "account_id"), "ledger_account")
    return files.join(hits.groupBy("name").agg(F.min_by("account_id", "i").alias("account_id")), "name", "left")


def triaged(files: DataFrame, ingested: DataFrame, registry: DataFrame) -> DataFrame:
    """files: name, sha256, account, ccy, has_partner; registry: account, ccy, seeded. The fate of every file, as ``status``."""
    reg = registry.select(F.trim("account").alias("account"), F.upper(F.trim("ccy")).alias("reg_ccy"), "seeded")
    rows = files.withColumn("account", F.trim("account")).withColumn("ccy", F.upper(F.trim("ccy")))
    rows = rows.join(reg, "account", "left").join(ingested.select("sha256", F.lit(True).alias("known")), "sha256", "left")
    status = (
        F.when(F.coalesce("known", F.lit(False)), "duplicate")
        .when(F.col("reg_ccy").isNull(), "unregistered")
        .when(F.col("reg_ccy") != F.col("ccy"), "mismatch")
        .when(~F.col("has_partner"), "no_partner")
        .when(F.col("seeded"), "already_seeded")
        .otherwise("ingested")
    )
    return rows.withColumn("status", status).drop("known")


#: Words that name a column, by field. The first field's first fitting column wins.
SYNONYMS = {
    "booking_date": ("booking date", "posting date", "entry date", "book date"),
    "ac_no": ("account number", "account no", "ac no", "ac_no", "account"),
    "ac_branch": ("branch code", "branch", "ac_branch"),
    "value_date": ("value date", "transaction date", "date"),
    "amount": ("amount", "value", "total"),
    "ref": ("reference", "ref", "transaction id", "id"),
    "narration": ("narration", "description", "details", "memo"),
    "currency": ("currency", "ccy"),
    "sign": ("dr/cr", "type", "sign", "direction"),
}


def guess_columns(columns: list[str]) -> dict[str, str]:
    """field -> column: equal names first, then names that hold a synonym."""
    out: dict[str, str] = {}
    for field, words in SYNONYMS.items():
        lower = {c.strip().lower(): c for c in columns if c not in out.values()}
        out_of = next((lower[w] for w in words if w in lower), None) or next((c for w in words for k, c in lower.items() if w in k), None)
        if out_of:
            out[field] = out_of
    return out


def valid_pair(rows: DataFrame, *by: str) -> DataFrame:
    """rows: account, ccy of the files of each pair (named by ``by``). Whether all files of it name one account and one currency."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    return rows.groupBy(*by).agg(F.coalesce(one("account"), F.lit(False)).alias("one_account"), F.coalesce(one("ccy"), F.lit(False)).alias("one_currency"))


def ledger_table(spark: SparkSession, url: str, query: str, *, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A core-banking extract over JDBC, read in ranges of ``key`` by as many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def balance_before(rows: DataFrame, day: int, keys: list[str]) -> DataFrame:
    """Per account the signed sum of the ledger rows (type, amount, value_date as yyyymmdd) before a day: its opening balance."""
    signed = F.when(F.col("type") == "CR", F.col("amount")).otherwise(-F.col("amount"))
    return rows.where(F.col("value_date") < day).groupBy(*keys).agg(F.round(F.sum(signed), 2).alias("opening"), F.count("*").alias("rows"))
