"""Faults that the review of round 4 found."""

from datetime import datetime, timedelta

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.operators import blocks
from tallyloom.operators import candidates as C
from tallyloom.operators import resolve as R
from tallyloom.streaming import late
from tests.test_matching import left, right


def _crowded(spark, amounts, rows=140):
    """Both sides without references, on nine days of three runs, all of few amounts: rows have many candidates, and some have none."""
    pick = random.Random(len(amounts))
    dates = [20240104, 20240105, 20240106, 20240110, 20240111, 20240131, 20240201, 20240202, 20240203]
    side = lambda n, make, **own: make(spark, *[dict(row=i + 1, date=pick.choice(dates), amount=pick.choice(amounts), **{k: pick.choice(v) for k, v in own.items()}) for i in range(n)])
    l, r = side(rows, left, sign="CD"), side(rows + 30, right, type=["DR", "CR"])
    return [x.withColumn("session_id", F.col("row_number") % 2) for x in (l, r)]


def _never(*_, **__):
    raise AssertionError


@pytest.mark.parametrize("amounts, routes", [([100.0, 200.0, 300.0, -0.0], ("amounts", "components")), ([100.0, 100.01, 100.02, 100.03, 500.0], ("components",))])
def test_colliding_amounts(spark, monkeypatch, amounts, routes):
    """Blocks give what the list of all pairs gives; where no candidate crosses amounts, days need not be connected."""
    l, r = _crowded(spark, amounts)
    pairs = C.candidates(l, r)
    won = R.greedy(pairs)
    shown = lambda df: sorted(tuple(x) for x in df.select("session_id", "l_row", "r_row", "tier").collect())
    listed = lambda df: sorted(tuple(x) for x in df.select("session_id", "winner_l", "winner_r", "place", "l_row", "r_row", "tier").collect())
    want, lost = shown(won), listed(R.top_competing(R.competing(pairs, won)))
    assert len(lost) > 2 * len(want)
    for route in routes:
        with monkeypatch.context() as m:
            m.setattr(blocks, "ONE_TASK", 0)
            m.setattr(*((blocks, "components", _never) if route == "amounts" else (blocks, "OF_AMOUNT", 0)))
            assert shown(R.assigned(l, r)) == want
            m.setattr(R, "written", _never)  # pairs of rows are not listed
            assert listed(R.top_rivals(l, r)) == lost


def test_rivals_of_rows_with_references(spark):
    l, r = left(spark, dict(row=1, ref="INV00123"), dict(row=2)), right(spark, dict(row=1), dict(row=2, ref="INV00123"))
    got = sorted(tuple(x) for x in R.top_rivals(l, r).select("winner_l", "winner_r", "place", "l_row", "r_row", "tier").collect())
    assert got == [(1, 2, 1, 1, 1, 3), (2, 1, 1, 2, 2, 3)]


def test_competing_topk_lists_no_pairs(spark, tmp_path, monkeypatch):
    """30,000 orders of one amount and day have some 13 million candidates a session."""
    monkeypatch.setattr(R, "greedy", _never)
    rows = spark.range(30000).selectExpr("id as o_orderkey", "1L as o_custkey", "'O' as o_orderstatus", "1000.0D as o_totalprice", "timestamp'1995-01-01' as o_orderdate", "'1' as o_orderpriority")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = __spark_entry__.queries()["competing_topk"](spark, str(tmp_path))
    of = got.groupBy("session_id", "winner_l").agg(F.count("*").alias("n"), F.max("place").alias("last")).groupBy("session_id").agg(F.count_if(F.expr("n = 6 and last = 6")).alias("whole"), F.max("n").alias("most"))
    found = of.collect()
    assert len(found) == 8 and all(2900 < x.whole <= 3750 and x.most == 6 for x in found)


def test_references_of_a_group_share_one_state_and_one_timer():
    """2,000 references with an open item each cost a group one value of the state and one timer a batch, and do not clear one another."""
    calls = {"put": 0, "timer": 0}

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            calls["put"] += 1
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        state = Value()

        def getValueState(self, *_):
            return self.state

        def registerTimer(self, at):
            calls["timer"] += 1

    class Now:
        def getExpiryTimeInMs(self):
            return int(datetime(2024, 1, 20).timestamp() * 1000)

        getCurrentWatermarkInMs = getExpiryTimeInMs

    waiting = late._WaitingGroup(0.01, 7 * late.DAY)
    waiting.init(Handle())
    at = datetime(2024, 1, 1)
    batch = lambda first, side, names: pd.DataFrame([(n, "item", first + i, side, 5.0, at + timedelta(seconds=i), None) for i, n in enumerate(names)], columns=["name", "kind", "item_id", "side", "amount", "at", "until"])
    names = [f"R{i}" for i in range(2000)]
    told = pd.concat(list(waiting.handleInputRows((0,), iter([batch(0, "ledger", names)]), None)))
    assert set(told["status"]) == {"open"} and len(told) == 2000 and calls == {"put": 1, "timer": 1}
    told = pd.concat(list(waiting.handleInputRows((0,), iter([batch(5000, "statement", names[:1990])]), None)))
    assert {r.item_id: r.other_id for r in told.itertuples()} == {**{i: 5000 + i for i in range(1990)}, **{5000 + i: i for i in range(1990)}}
    assert Handle.state.held[0] == names[1990:] and calls["put"] == 2
    told = pd.concat(list(waiting.handleExpiredTimer((0,), Now(), Now())))
    assert list(told["item_id"]) == list(range(1990, 2000)) and set(told["status"]) == {"escalated"} and calls["put"] == 3
    list(waiting.handleInputRows((0,), iter([batch(9000, "statement", names[1990:])]), None))
    assert Handle.state.held is None
