"""Queries over card files: groups with their filters, drill-in, recomputation, pages and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import cards
from tallyloom.plans import derived as D

Q, O = {}, {}
SINCE, UNTIL, AT = "2024-01-05", "2024-01-30", "2024-02-01 00:00:00"


def query(sql):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


_RECORDS = D.CARDS + """, rec AS (SELECT file_id + 3 * (k % 12) AS file_id, k * 4 + file_id AS record_index, CASE WHEN k % 29 = 3 THEN '' WHEN k % 50 = 7 THEN 'UNKNOWN' ELSE scheme_ref END AS scheme_ref, amount, CASE WHEN k % 13 = 0 THEN 'eur' ELSE 'USD' END AS currency,
  CASE WHEN k % 17 = 0 THEN NULL ELSE lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS pan_last4, recon_status FROM cards),
fil AS (SELECT i AS file_id, CASE WHEN (i - 1) // 3 % 2 = 0 THEN 'alpha' ELSE 'beta' END AS scheme, ['settlement', 'auth', 'clearing'][CAST(i % 3 AS INTEGER) + 1] AS stage, DATE '2024-01-01' + CAST(i AS INTEGER) AS settlement_date FROM (SELECT unnest(range(1, 41)) AS i)),
named AS (SELECT * FROM rec WHERE scheme_ref <> ''),
pop AS (SELECT * FROM named JOIN fil USING (file_id)), few AS (SELECT * FROM pop WHERE settlement_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-30')"""


def _of(population: str) -> str:
    return f"""g AS (SELECT scheme_ref, count(*) AS records, count(DISTINCT file_id) AS files, min(amount) AS lowest, max(amount) AS highest, max(amount) - min(amount) AS spread, count(DISTINCT stage) AS stages,
  list_sort(list(DISTINCT file_id)) AS file_ids, list_sort(list(DISTINCT upper(currency))) AS currencies, list_sort(list(DISTINCT scheme)) AS schemes, list_sort(coalesce(list(DISTINCT pan_last4) FILTER (WHERE pan_last4 IS NOT NULL), [])) AS ends FROM {population} GROUP BY 1),
s AS (SELECT *, CASE WHEN files <= 1 THEN 'unmatched' WHEN spread > 0.01 + 1e-9 THEN 'mismatched' WHEN stages < 3 THEN 'incomplete' ELSE 'matched' END AS status FROM g)"""


def _records(spark, d):
    """Three dozen files; some records without a reference, and one placeholder reference that many share."""
    k = F.col("k")
    return D.card_records(spark, d).select(
        (F.col("file_id") + 3 * (k % 12)).alias("file_id"), (k * 4 + F.col("file_id")).alias("record_index"), F.when(k % 29 == 3, "").when(k % 50 == 7, "UNKNOWN").otherwise(F.col("scheme_ref")).alias("scheme_ref"), "amount",
        F.when(k % 13 == 0, "eur").otherwise("USD").alias("currency"), F.when(k % 17 != 0, F.lpad((k % 10000).cast("string"), 4, "0")).alias("pan_last4"), "recon_status",
    )


def _files(spark):
    i = F.col("id")
    stage = F.element_at(F.array(F.lit("settlement"), F.lit("auth"), F.lit("clearing")), (i % 3 + 1).cast("int"))
    return spark.range(1, 41).select(i.alias("file_id"), F.when(F.floor((i - 1) / 3) % 2 == 0, "alpha").otherwise("beta").alias("scheme"), stage.alias("stage"), F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int")).alias("settlement_date"))


def _range():
    return {"since": F.lit(SINCE).cast("date"), "until": F.lit(UNTIL).cast("date")}


@query("WITH " + _RECORDS + "," + _of("few") + """ SELECT scheme_ref, status, records, files, array_to_string(file_ids, ';') AS file_ids, printf('%.2f', lowest) AS lowest, printf('%.2f', highest) AS highest, printf('%.2f', spread) AS spread,
 array_to_string(currencies, ';') AS currencies, array_to_string(schemes, ';') AS schemes, md5(array_to_string(ends, ';')) AS ends_md5 FROM s""")
def card_groups_export(spark, d):
    """Groups of a range of days, as their export holds them; the sum of a group is tested aside, as its last digit depends on the order of addition."""
    sheet = cards.groups_sheet(cards.match_groups(_records(spark, d), _files(spark), **_range()))
    return sheet.withColumn("ends_md5", F.md5("pan_last4_set")).drop("total", "pan_last4_set")


@query("WITH " + _RECORDS + """ SELECT file_id, scheme, stage, CAST(settlement_date AS VARCHAR) AS settlement_date, count(record_index) AS record_count, CAST(coalesce(sum(CAST(round(amount * 100) AS BIGINT)), 0) AS BIGINT) AS total_cents FROM fil LEFT JOIN rec USING (file_id) GROUP BY ALL""")
def card_files_export(spark, d):
    return cards.files_sheet(_files(spark), _records(spark, d)).withColumn("total_cents", F.round(F.col("total_amount").cast("decimal(38,2)") * 100).cast("long")).drop("total_amount")


@query("WITH " + _RECORDS + """ SELECT CAST(record_index AS VARCHAR) AS record_index, scheme_ref, CAST(round(amount * 100) AS BIGINT) AS cents, currency, coalesce(pan_last4, '') AS pan_last4, recon_status FROM rec WHERE file_id = 5""")
def card_records_export(spark, d):
    sheet = cards.records_sheet(_records(spark, d), 5)
    return sheet.withColumn("cents", F.round(F.col("amount").cast("double") * 100).cast("long")).drop("amount")


@query("WITH " + _RECORDS + " SELECT record_index, scheme_ref, amount FROM rec WHERE file_id = 5 ORDER BY record_index LIMIT 500 OFFSET 100")
def card_records_page(spark, d):
    return cards.page(_records(spark, d), 5, 10_000, 100).select("record_index", "scheme_ref", "amount")


@query("WITH " + _RECORDS + "," + _of("pop") + """ SELECT p.scheme_ref, record_index, p.file_id, scheme, stage, round(amount - s.lowest, 4) AS gap FROM pop p JOIN s ON s.scheme_ref = p.scheme_ref WHERE status = 'mismatched'""")
def card_drill_in(spark, d):
    """Every record of every group whose amounts disagree, the placeholder's among them."""
    r, f = _records(spark, d), _files(spark)
    return cards.drilled(r, f, cards.match_groups(r, f).where("status = 'mismatched'")).select("scheme_ref", "record_index", "file_id", "scheme", "stage", F.round("gap", 4).alias("gap"))


_AFTER = "WITH " + _RECORDS + "," + _of("few") + """, after AS (SELECT r.record_index, r.file_id, CASE WHEN s.status IS NULL OR settlement_date NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-30' THEN NULL WHEN recon_status = 'disputed' THEN 'protected' ELSE 'updated' END AS outcome, r.recon_status, s.status
 FROM rec r JOIN fil USING (file_id) LEFT JOIN s ON s.scheme_ref = r.scheme_ref)"""


def _recomputed(spark, d):
    r, f = _records(spark, d), _files(spark)
    found = cards.match_groups(r, f, **_range())
    return found, cards.recomputed(r, f, F.lit(AT).cast("timestamp"), "u1", found, **_range())


@query(_AFTER + """ SELECT record_index, file_id, outcome, CASE WHEN outcome = 'updated' THEN status ELSE recon_status END AS recon_status, CASE WHEN outcome = 'updated' AND status = 'matched' THEN TIMESTAMP '2024-02-01 00:00:00' END AS matched_at,
 CASE WHEN outcome = 'updated' AND status = 'matched' THEN 'u1' END AS matched_by FROM after""")
def card_recompute(spark, d):
    return _recomputed(spark, d)[1].select("record_index", "file_id", "outcome", "recon_status", "matched_at", "matched_by")


@query(_AFTER + """ SELECT (SELECT count(*) FROM s) AS groups_total, (SELECT count(*) FROM s WHERE status = 'mismatched') AS mismatched, (SELECT count(*) FROM s WHERE status = 'incomplete') AS incomplete, (SELECT count(*) FROM s WHERE status = 'matched') AS matched,
 (SELECT count(*) FROM s WHERE status = 'unmatched') AS unmatched, count(*) FILTER (WHERE outcome = 'updated') AS records_updated, count(*) FILTER (WHERE outcome = 'protected') AS records_protected FROM after""")
def card_recompute_result(spark, d):
    return cards.recompute_result(*_recomputed(spark, d))
