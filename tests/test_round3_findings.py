"""Faults that the review of round 3 found."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.operators import candidates as C
from tallyloom.operators import splits
from tallyloom.operators import tiers as T
from tallyloom.operators.tolerance import Tolerance, window
from tallyloom.sinks.tables import sheet_bytes
from tallyloom.sources import camt, csv_profile, xlsx
from tallyloom.streaming import flows, late
from tests.test_matching import left, right


def test_waiting_items_touch_the_state_once_a_batch():
    """4,000 items that clear one another within a batch leave no trace in the state; 10 that wait are told once, with one timer."""
    calls = {"put": 0, "timer": 0}

    class Map(dict):
        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, key, value):
            calls["put"] += 1
            self[key[0]] = value

        def removeKey(self, key):
            del self[key[0]]

    class Handle:
        state = Map()

        def getMapState(self, *_):
            return self.state

        def registerTimer(self, _):
            calls["timer"] += 1

    waiting = late._Waiting(0.01, 7 * late.DAY)
    waiting.init(Handle())
    at = datetime(2024, 1, 1)
    rows = [("item", i, "statement" if i % 2 else "ledger", float(i // 2 % 50), at + timedelta(seconds=i), None) for i in range(4000)]
    rows += [("item", 5000 + i, "ledger", 900.0 + i, at + timedelta(seconds=i), None) for i in range(10)]
    batch = pd.DataFrame(rows, columns=["kind", "item_id", "side", "amount", "at", "until"])
    told = pd.concat(list(waiting.handleInputRows(("a", "r"), iter([batch]), None)))
    assert sorted(Handle.state) == list(range(5000, 5010)) and calls == {"put": 10, "timer": 1}
    assert {r.item_id: r.other_id for r in told.itertuples() if r.status == "cleared"} == {i: i ^ 1 for i in range(4000)}


def test_workbooks_are_handed_on_file_by_file(monkeypatch):
    """So many rows at once, whatever number of workbooks comes in one batch; a broken one is one error row among them."""

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, read, _):
            return read

    monkeypatch.setattr(xlsx, "AT_ONCE", 10)
    book = sheet_bytes("s", ["a", "b"], [(f"x{i}", i) for i in range(24)])
    parts = list(xlsx.rows(Files())(iter([pd.DataFrame({"path": ["p", "broken", "q"], "content": [book, book[:200], book]})])))
    assert [len(x) for x in parts] == [10, 10, 5, 1, 10, 10, 5]
    assert [list(x["path"].unique()) for x in parts] == [["p"]] * 3 + [["broken"]] + [["q"]] * 3
    assert list(parts[2]["cells"])[-1] == ["x23", "23"] and parts[3]["error"][0].startswith("BadZipFile")


def test_luhn_mask_takes_sixteen_digits_in_a_row(spark, tmp_path):
    rows = [(1, "pay 4495589438270767 42.73.240.87"), (2, "42 4366089147969128 x"), (3, "068c002651439458202064d3"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()["luhn_mask"](spark, str(tmp_path)).collect()}
    assert got == {(1, "4495589438270767", "449558***0767"), (2, "4366089147969128", "436608***9128")}


def test_equal_amounts_of_many_days_meet_by_day(spark):
    """3,000 equal amounts on as many days: three candidates a row, where amounts alone would give nine million."""
    day = lambda i: int((datetime(2010, 1, 1) + timedelta(days=i)).strftime("%Y%m%d"))
    l = left(spark, *[dict(row=i, date=day(i)) for i in range(3000)])
    r = right(spark, *[dict(row=i, date=day(i)) for i in range(3000)])
    tiers = [t for t in T.default_tiers() if not T.needs_reference(t)]
    assert T.days_apart(T.default_tiers()) == T.days_apart(tiers) == 1
    pairs = C._by_amount(*C.sides(l, r, tiers), Tolerance(), T.days_apart(tiers))
    assert pairs.count() == C.candidates(l, r, tiers).count() == 3 * 3000 - 2


def test_days_bound_only_pairs_without_reference(spark):
    """Against all pairs of near amounts, judged by the tiers: invalid and absent dates, references inside texts on any day, percentages."""
    rng = random.Random(8)
    dates = [0, 20240229, 20240230, 20240301, 20240302, 20240304, 20231231, 20240101]
    l = left(spark, *[dict(row=i, date=rng.choice(dates), amount=rng.choice([100.0, 100.01, 101.0]), ref=rng.choice(["", "ABC123456"]), t1=rng.choice(["", "xINV0099881x"])) for i in range(120)])
    r = right(spark, *[dict(row=i, date=rng.choice(dates), amount=rng.choice([100.0, 100.01, 101.0]), ref=rng.choice(["", "INV0099881"]), n=rng.choice(["", "zABC123456z"])) for i in range(120)])
    for tol in (Tolerance(), Tolerance(amount_pct=2.0)):
        for tiers in (T.default_tiers(), T.default_tiers()[2:], [T.of(1, "amount", ("sign", "mirror"), ("amount", "equal_within_tol")), *T.default_tiers()[2:]]):
            rows = l.select(F.struct("*").alias("l")).crossJoin(r.select(F.struct("*").alias("r")))
            wanted = rows.withColumn("t", T.first_tier(tiers, F.col("l"), F.col("r"), tol)).where("t is not null").where(F.abs(F.col("r.amount") - F.col("l.amount")) <= window(F.col("l.amount"), tol)).select("l.row_number", "r.row_number", "t.tier")
            got = C.candidates(l, r, tiers, tol).select("l_row", "r_row", "tier").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, wanted.collect()))


def test_contained_keys_compare_what_is_contained(spark):
    """20,000 keys of twelve random digits share all their grams of four; none is compared with another but those that lie inside."""
    digits = F.substring(F.sha2(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), 256), 1, 12)
    keys = spark.range(20000).select(F.lit(1).alias("session_id"), F.lit("DR").alias("type"), F.translate(digits, "abcdef", "012345").alias("key")).distinct()
    pairs, compared = splits.contained_keys(keys)
    assert compared.count() == pairs.count() == 0
    rng = random.Random(4)
    long = ["".join(rng.choice("AB") for _ in range(n)) for n in (64, 65, 70, 150)]
    some = [(s, "DR", k) for s in (1, 2) for k in {*long, "x" + long[0], long[1] + "y", long[2][:68], long[3][5:80], long[3][40:104], long[3][:30], long[0][20:24], "A" * 70, "A" * 64, "A" * 90, "AB"}]
    got = splits.contained_keys(spark.createDataFrame(some, "session_id long, type string, key string"))[0].collect()
    assert sorted((r.session_id, r.inner, r.outer) for r in got) == sorted((s, a, b) for s, _, a in some for t, _, b in some if s == t and a != b and a in b)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_anchors_of_many_accounts_in_few_groups(spark, tmp_path, kind):
    """2,000 accounts over two batches, in three groups; one state, no group for each account."""
    rng, at = random.Random(5), datetime(2024, 1, 1)
    shape = lambda i: (None if i == 7 else 2**60 + i if kind == "long" else f"a{i}")
    rows = [(shape(i), at + timedelta(days=n), rng.choice([10.0, 10.01, 11.0]), rng.choice([10.0, 11.0, 12.0])) for i in range(2000) for n in range(4)]
    into, got = str(tmp_path / "run"), None
    for n, part in enumerate((lambda r: r[1] < at + timedelta(days=2), lambda r: r[1] >= at + timedelta(days=2))):
        some = [r for r in rows if part(r)]
        rng.shuffle(some)
        spark.createDataFrame(some, f"account_id {kind}, seq timestamp_ntz, opening double, closing double").repartition(3).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(f"account_id {kind}, seq timestamp_ntz, opening double, closing double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = flows.drained(flows.anchor_state(stream, buckets=3), "append", into=into)
    anchor, want = {}, []
    for account, seq, opening, closing in rows:
        before = anchor.get(account)
        fits = before is None or abs(round(opening - before, 4)) <= 0.01
        want.append((account, seq, before, fits))
        anchor[account] = closing if fits else before
    order = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("few", [0, 2000])
def test_a_file_in_parts_is_read_as_one(spark, tmp_path, monkeypatch, few):
    """Folders of parts in several splits, the header in the first part alone; numbers go on from part to part."""
    monkeypatch.setattr(csv_profile, "FEW_TASKS", few)
    plain = csv_profile.PRESETS["plain"]
    for f, sizes in (("f=0", (700, 1, 900)), ("f=1", (5,))):
        n = 0
        (tmp_path / f).mkdir()
        for part, size in enumerate(sizes):
            rows = [f"2024-01-05,{f}-{n + i},m,{n + i}.50" for i in range(size)]
            (tmp_path / f / f"part-{part:05d}.txt").write_text("\n".join((["Date,Ref,Memo,Amount"] if part == 0 else []) + rows) + "\n")
            n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = csv_profile.read_lines(spark, f"file://{tmp_path}", plain, parts=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.path.rsplit("/", 1)[-1], r.row_number, r.extra["Ref"]) for r in rows) == sorted((f, i + 1, f"{f}-{i}") for f, n in (("f=0", 1601), ("f=1", 5)) for i in range(n))


def test_a_file_of_all_orders_is_written_by_many_tasks(spark, monkeypatch):
    """Each sorts some hundred lines, where three tasks sorted them all; what is read back is numbered as before."""
    import glob

    from tallyloom.operators.store import shared_folder
    from tallyloom.plans import intake

    monkeypatch.setattr(intake, "LINES", 100)
    got = intake.source_csv_splits(spark, "/root/testdata/sf0.001")
    folder = max(glob.glob(shared_folder(spark).removeprefix("file://") + "/splits-*"), key=os.path.getmtime)
    lines = [sum(1 for _ in open(p)) for p in glob.glob(folder + "/f=*/part-*")]
    assert len(lines) > 10 and max(lines) < 300
    want = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("concat('R', o_orderkey) r", "row_number() over (partition by o_custkey % 3 order by o_orderkey) n")
    assert sorted((r.trn_ref, r.row_number) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_whole_files_come_in_small_batches(spark):
    """The plan that reads camt files is given few at once, whatever the session had."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    files = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.lit("<A><Stmt><Id>S</Id></Stmt></A>").alias("text")).coalesce(1)
    for read in (camt.entries, camt.statements):
        spark.conf.set(name, "10000")
        try:
            found = read(files)
            sizes = files.mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long").collect()
            assert max(r.n for r in sizes) <= 200 and found.count() == (3000 if read is camt.statements else 0)
        finally:
            spark.conf.set(name, before)
