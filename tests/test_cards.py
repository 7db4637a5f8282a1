"""Card files: groups, drill-in, recomputation and exports on small rows with nulls, blanks, a placeholder and protected records."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cards

FILES = "file_id long, scheme string, stage string, settlement_date date"
RECORDS = "file_id long, record_index long, scheme_ref string, amount double, currency string, pan_first6 string, pan_last4 string, recon_status string"


@pytest.fixture(scope="module")
def given(spark):
    files = [(1, "alpha", "auth", date(2024, 1, 1)), (2, "alpha", "clearing", date(2024, 1, 2)), (3, "beta", "settlement", date(2024, 1, 3)), (4, "beta", None, None)]
    rows = [
        (1, 1, "A", 10.0, "usd", "411111", "1111", "new"), (2, 1, "A", 10.01, "USD", "411111", "1111", "disputed"), (3, 1, "A", 10.0, None, None, " ", "matched"),
        (1, 2, "B", 5.0, "USD", None, None, "new"), (2, 2, "B", 6.0, "EUR", None, "2222", None), (1, 3, "C", 1.0, "USD", None, None, "new"), (2, 3, "C", 1.0, "USD", None, None, "new"),
        (1, 4, "D", None, "USD", None, None, "new"), (1, 5, "", 3.0, "USD", None, None, "new"), (1, 6, None, 3.0, "USD", None, None, "new"), (4, 1, "C", 1.0, "USD", None, None, "written_off"),
    ]
    return spark.createDataFrame(rows, RECORDS), spark.createDataFrame(files, FILES)


def test_groups_show_what_they_hold(given):
    found = {r.scheme_ref: r for r in cards.match_groups(*given).collect()}
    assert {k: r.status for k, r in found.items()} == {"A": "matched", "B": "mismatched", "C": "incomplete", "D": "unmatched"}
    a = found["A"]
    assert (a.file_ids, a.currencies, a.schemes, a.pan_last4_set) == ([1, 2, 3], ["USD"], ["alpha", "beta"], ["1111"])
    assert found["D"].pan_last4_set == [] and found["D"].spread is None


def test_filters_narrow_the_records(given):
    one = cards.match_groups(*given, scheme="alpha")
    assert {r.scheme_ref: (r.status, r.files) for r in one.collect()} == {"A": ("incomplete", 2), "B": ("mismatched", 2), "C": ("incomplete", 2), "D": ("unmatched", 1)}
    late = cards.match_groups(*given, since=F.lit("2024-01-03").cast("date"))
    assert [r.scheme_ref for r in late.collect()] == ["A"]


def test_drill_in_shows_each_record_once(spark, given):
    refs = spark.createDataFrame([("B",), ("B",), ("none",), (None,)], "scheme_ref string")
    rows = cards.drilled(*given, refs).collect()
    assert sorted((r.scheme_ref, r.record_index, r.stage, r.gap) for r in rows) == [("B", 2, "auth", 0.0), ("B", 2, "clearing", 1.0)]


def test_recomputation_keeps_what_operators_set(given):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    found = cards.match_groups(*given)
    after = cards.recomputed(*given, at, "u", found)
    rows = {(r.file_id, r.record_index): (r.outcome, r.recon_status, r.matched_at, r.matched_by) for r in after.collect()}
    assert len(rows) == 11
    assert rows[1, 1] == ("updated", "matched", datetime(2024, 2, 1), "u") and rows[2, 1] == ("protected", "disputed", None, None)
    assert rows[2, 2] == ("updated", "mismatched", None, None) and rows[4, 1] == ("protected", "written_off", None, None)
    assert rows[1, 5] == (None, "new", None, None) and rows[1, 6] == (None, "new", None, None)
    assert cards.recompute_result(found, after).first().asDict() == {"groups_total": 4, "mismatched": 1, "incomplete": 1, "matched": 1, "unmatched": 1, "records_updated": 7, "records_protected": 2}
    again = cards.recomputed(after.drop("outcome"), given[1], at, "u")
    assert sorted(map(str, again.select(after.columns).collect())) == sorted(map(str, after.collect()))
    some = cards.recomputed(*given, at, "u", scheme="beta")
    assert {(r.file_id, r.record_index): r.recon_status for r in some.where("outcome = 'updated'").collect()} == {(3, 1): "unmatched"}


def test_exports_and_pages(spark, given):
    records, files = given
    sheet = [tuple(r) for r in cards.groups_sheet(cards.match_groups(records, files)).collect()]
    assert sheet[0] == ("B", "mismatched", 2, 2, "1;2", "5.00", "6.00", "11.00", "1.00", "EUR;USD", "alpha", "2222")
    assert [r[0] for r in sheet] == ["B", "C", "A", "D"] and sheet[3][5:9] == ("0.00",) * 4
    assert [r.scheme_ref for r in cards.groups_sheet(cards.match_groups(records, files), "matched").collect()] == ["A"]
    listed = {r.file_id: (r.settlement_date, r.record_count, r.total_amount) for r in cards.files_sheet(files, records.where("file_id <> 3")).collect()}
    assert listed[1] == ("2024-01-01", 6, "22.00") and listed[3] == ("2024-01-03", 0, "0.00") and listed[4][0] == ""
    rows = cards.records_sheet(records, 2).collect()
    assert [(r.record_index, r.scheme_ref, r.pan_first6, r.recon_status) for r in rows] == [("1", "A", "411111", "disputed"), ("2", "B", "", ""), ("3", "C", "", "new")]
    with pytest.raises(ValueError):
        cards.records_sheet(records.withColumnRenamed("pan_first6", "PAN"), 2)
    assert [r.record_index for r in cards.page(records, 1, 2, 1).collect()] == [2, 3] and cards.page(records, 1, offset=-5).count() == 6


def test_empty_tables(spark, given):
    none, files = given[0].limit(0), given[1].limit(0)
    found = cards.match_groups(none, files)
    assert found.count() == 0 and cards.files_sheet(given[1], none).count() == 4
    assert cards.recompute_result(found, cards.recomputed(none, files, F.current_timestamp(), found=found)).first()["records_updated"] == 0
