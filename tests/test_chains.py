"""Chains of files in ranges, waiting items with timers, sessions stored once, a bank's tables over JDBC: against plain Python."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.sinks import tables
from tallyloom.sources import files
from tallyloom.streaming import flows, late


def folded(chain, tol=0.01):
    out, anchor = [], {}
    for account, seq, opening, closing, forced in sorted(chain, key=lambda x: (x[0], x[1])):
        before = anchor.get(account)
        ok = before is None or forced or (opening is not None and round(abs(round(opening - before, 4)), 4) <= tol)
        out.append((account, seq, before, ok))
        if ok:
            anchor[account] = closing
    return out


@pytest.mark.parametrize("misfits", [0.05, 0.6])
def test_continuity_in_ranges_equals_the_fold(spark, misfits):
    """One account has most files; long runs of refused files reach over several ranges."""
    rng, chain = random.Random(3), []
    for account, n in ((1, 900), (2, 40), (3, 1), (4, 200)):
        balance = 100.0
        for seq in range(n):
            opening = balance if rng.random() > misfits else rng.choice([balance + 0.01, balance + 5, 77.0])
            closing = rng.choice([100.0, 77.0, round(opening + rng.randrange(-3, 4), 2)])
            chain.append((account, seq, opening if rng.random() > 0.01 else None, closing if rng.random() > 0.005 else None, rng.random() < 0.01))
            balance = closing if rng.random() > misfits / 2 else balance
    rng.shuffle(chain)
    frame = spark.createDataFrame(chain, "account_id long, seq int, opening double, closing double, forced boolean")
    got = ledger.continuity(frame, forced="forced", parts=37)
    assert got.columns == ["account_id", "seq", "opening", "closing", "forced", "anchor", "gap", "accepted"]
    assert sorted(((x.account_id, x.seq, x.anchor, x.accepted) for x in got.collect()), key=lambda x: x[:2]) == folded(chain)
    assert ledger.continuity(frame.limit(0)).count() == 0


ITEM = "account_id long, ref string, kind string, item_id long, side string, amount double, at timestamp, until timestamp"


def test_late_counterparts_go_on_after_a_restart(spark, tmp_path):
    """Repeated references, tolerance, snooze and escalation over two runs of one checkpoint."""
    day = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    item = lambda i, side, amount, n, ref="R": (1, ref, "item", i, side, amount, day(n), None)
    first = [item(1, "statement", 10.0, 0), item(2, "statement", 10.0, 1), item(3, "ledger", 10.005, 2), item(4, "ledger", 99.0, 2), item(5, "statement", 7.0, 2, "S"), (1, "S", "snooze", 5, "", 0.0, day(2, 1), day(30)), item(6, "ledger", 50.0, 20, "T")]
    second = [item(7, "ledger", 10.0, 21), item(8, "statement", 99.5, 22), item(9, "ledger", 1.0, 45, "U")]
    source, into = tmp_path / "in", f"file://{tmp_path}/out"

    def run(rows):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(ITEM).parquet(f"file://{source}")
        got = flows.drained(late.late_counterparts(stream), "update", merge=flows.latest("item_id"), into=into, timers=True)
        return {r.item_id: (r.status, r.other_id) for r in got.collect()}

    before = run(first)
    assert before[1] == ("cleared", 3) and before[3] == ("cleared", 1)
    assert before[2] == ("escalated", None) and before[4] == ("escalated", None)  # a week has passed at day 20, less a day for late rows
    assert before[5] == ("open", None) and before[6] == ("open", None)
    after = run(second)
    assert after[2] == ("cleared", 7) and after[7] == ("cleared", 2)  # its other side comes at last
    assert after[4] == ("escalated", None) and after[8] == ("escalated", None) and after[6] == ("escalated", None)
    assert after[5] == ("escalated", None)  # once the snooze is over
    assert after[9] == ("open", None) and set(after) == set(range(1, 10))


def test_a_session_that_is_stored_again_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/sessions"
    rows = spark.range(40).select((F.col("id") % 4).alias("session_id"), F.col("id").alias("row_number"))
    tables.append_sessions(rows, path)
    tables.append_sessions(rows.where("session_id = 2").withColumn("row_number", F.col("row_number") + 1000), path)
    tables.append_sessions(rows.where("session_id = 3"), path)
    got = sorted((r.session_id, r.row_number) for r in spark.read.parquet(path).collect())
    assert got == sorted((r.session_id, r.row_number + (1000 if r.session_id == 2 else 0)) for r in rows.collect())


def test_core_banking_tables_are_read_in_parts_with_their_filters(spark):
    spark.sparkContext._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(1, 1001).select(F.col("id").alias("ID"), (F.col("id") % 7).alias("BRANCH"), (F.col("id") * 1.5).alias("AMOUNT"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="POSTINGS", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = files.ledger_table(spark, url, "SELECT ID, BRANCH, AMOUNT FROM POSTINGS", key="ID", low=1, high=1000, parts=5, driver="org.apache.derby.jdbc.EmbeddedDriver")
    some = got.where("BRANCH = 3 AND AMOUNT > 100")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 5 and "EqualTo(BRANCH,3)" in plan and "GreaterThan(AMOUNT,100.0)" in plan
    assert sorted(r.ID for r in some.collect()) == [i for i in range(1, 1001) if i % 7 == 3 and i * 1.5 > 100]
