"""Card files and their records: groups with all that their list shows, drill-in, recomputation, and what the exports hold.

files: file_id, scheme, stage, settlement_date, ... ; records: file_id, record_index, scheme_ref, amount, currency, pan_first6,
pan_last4, recon_status, ... A placeholder reference may hold any share of all records: groups are summed up before they are shuffled
and hold sets of files, currencies, card ends and schemes, never lists of records; what concerns records is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import pan
from tallyloom.operators import groups as G
from tallyloom.operators.listings import records_of_files

SETS = {"file_id": "file_ids", "currency": "currencies", "scheme": "schemes", "pan_last4": "pan_last4_set"}
PAGE = 500


def match_groups(records: DataFrame, files: DataFrame, tolerance: float = 0.01, required: tuple[str, ...] = G.STAGES, **only: object) -> DataFrame:
    """The groups of :func:`groups.groups` with file_ids, currencies (in capitals), schemes and pan_last4_set, each sorted and without blanks.

    ``only``: scheme, since and until, as :func:`listings.records_of_files` takes them.
    """
    rows = records_of_files(records.drop("stage", "scheme", "settlement_date"), files, **only)
    shown = lambda c: F.upper(c) if c == "currency" else F.col(c)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return G.groups(rows, tolerance, required, [F.array_sort(F.collect_set(F.when(~blank(c), shown(c)))).alias(name) for c, name in SETS.items()])


def drilled(records: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Every record of the asked ``refs`` (scheme_ref) with its file's scheme, stage and day, and ``gap``: how far it lies above its reference's lowest amount.

    The lowest amounts are a table of one row a reference, so records of a very frequent reference stay where they are read.
    """
    asked = refs.select("scheme_ref").distinct()
    rows = records_of_files(records.drop("stage", "scheme", "settlement_date").join(asked, "scheme_ref", "left_semi"), files)
    least = rows.groupBy("scheme_ref").agg(F.min("amount").alias("_least"))
    return rows.join(least, "scheme_ref").withColumn("gap", F.col("amount") - F.col("_least")).drop("_least")


def recomputed(records: DataFrame, files: DataFrame, at: Column, actor: str = "system", found: DataFrame | None = None, **only: object) -> DataFrame:
    """``records`` after a recomputation, with ``outcome``: updated, protected, or null for records that it does not concern.

    Records of the chosen files with a reference take their group's status, and matched_at and matched_by if that is matched (null
    otherwise). What an operator has set (disputed, written off) stays with its time and name. Running it again changes no status.
    """
    found = match_groups(records, files, **only) if found is None else found
    chosen = records_of_files(files.select("file_id", F.lit("-").alias("scheme_ref")), files, **only).select("file_id", F.lit(True).alias("_chosen"))
    rows = records.join(chosen, "file_id", "left").join(found.select("scheme_ref", F.col("status").alias("_status")), "scheme_ref", "left")
    concerned = F.coalesce("_chosen", F.lit(False)) & F.col("_status").isNotNull()
    outcome = F.when(concerned, F.when(F.coalesce(F.col("recon_status").isin(*G.PROTECTED), F.lit(False)), "protected").otherwise("updated"))
    before = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    updated, matched = F.coalesce(F.col("outcome") == "updated", F.lit(False)), F.col("_status") == "matched"
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumns(
        {
            "recon_status": F.when(updated, F.col("_status")).otherwise(F.col("recon_status")),
            "matched_at": F.when(updated, F.when(matched, at)).otherwise(before("matched_at", "timestamp")),
            "matched_by": F.when(updated, F.when(matched, F.lit(actor))).otherwise(before("matched_by", "string")),
        }
    ).drop("_chosen", "_status")


def recompute_result(found: DataFrame, after: DataFrame) -> DataFrame:
    """One row: groups_total and groups of each status, records_updated and records_protected."""
    groups = found.agg(F.count("*").alias("groups_total"), *[F.count_if(F.col("status") == s).alias(s) for s in G.ORDER])
    return groups.crossJoin(after.agg(F.count_if(F.col("outcome") == "updated").alias("records_updated"), F.count_if(F.col("outcome") == "protected").alias("records_protected")))


def page(records: DataFrame, file_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of at most 500 records of a file, by their place in it."""
    return records.where(F.col("file_id") == file_id).orderBy("record_index").offset(max(offset, 0)).limit(min(limit, PAGE))


def _money(c: str) -> Column:
    return F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))


def groups_sheet(found: DataFrame, status: str | None = None) -> DataFrame:
    """Groups as an export holds them: amounts with two decimals, sets joined by semicolons; the worst first."""
    rows = found if status is None else found.where(F.col("status") == status)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return G.ordered(rows).select("scheme_ref", "status", "records", "files", joined("file_ids"), *[_money(c).alias(c) for c in ("lowest", "highest", "total", "spread")], *[joined(c) for c in ("currencies", "schemes", "pan_last4_set")])


def files_sheet(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files as an export holds them, with the number and the sum of their records; files without any are listed too."""
    sums = records.groupBy("file_id").agg(F.count("*").alias("record_count"), F.sum("amount").alias("total_amount"))
    rows = files.drop("record_count", "total_amount").join(sums, "file_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("file_id", *[text(c) for c in files.columns if c not in ("file_id", "record_count", "total_amount")], F.coalesce("record_count", F.lit(0)).alias("record_count"), _money("total_amount").alias("total_amount"))


def records_sheet(records: DataFrame, file_id: int) -> DataFrame:
    """A file's records as an export holds them, in their order, nulls as empty cells. Whole card numbers are refused by name."""
    rows = pan.refuse(records.where(F.col("file_id") == file_id), [])
    return rows.orderBy("record_index").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in records.columns if c != "file_id"])
