"""Items of a stream that wait for their counterpart: tolerance, snooze and escalation, with state and timers of their own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.streaming.flows import BUCKETS

DAY = 24 * 3600 * 1000
OUT = "item_id long, status string, other_id long, at timestamp"
_STATE = "side string, amount double, at long, due long, escalated boolean"
_STATES = "name array<string>, item_id array<long>, side array<string>, amount array<double>, at array<long>, due array<long>, escalated array<boolean>"


class _Waiting(StatefulProcessor):
    """The open items of one account and reference, by id. The state is told once a batch what a batch has changed; a reference has one timer, at the earliest time at which an item is due."""

    def __init__(self, tolerance: float, after: int):
        self.tolerance, self.after = tolerance, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getMapState("open", "item_id long", _STATE)

    def close(self) -> None:
        pass

    def _held(self) -> dict[str | None, dict[int, tuple]]:
        """The open items of the state, by the name of their reference (here there is one, and it needs no name) and by id."""
        return {None: {k[0]: tuple(v) for k, v in self.open.iterator()}}

    def _keep(self, before: dict[str | None, dict[int, tuple]], held: dict[str | None, dict[int, tuple]]) -> None:
        old, new = before.get(None, {}), held.get(None, {})
        for item in old.keys() - new.keys():
            self.open.removeKey((item,))
        for item, v in new.items():
            if old.get(item) != v:
                self.open.updateValue((item,), v)

    def _wake(self, dues: list[int], due_before: list[int]) -> None:
        """One timer, at the earliest of ``dues``. Where an earlier one stands already, nothing falls due before it."""
        if dues and (not due_before or min(dues) < min(due_before)):
            self.handle.registerTimer(min(dues))

    def _bin(self, amount: float) -> float:
        return amount // (2 * self.tolerance + 4e-9)  # amounts within the tolerance are in the same or in neighbouring bins

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch["rank"] = (batch["kind"] != "item").astype(int)  # what is said of an item comes behind it
        batch = batch.sort_values(["at", "rank", "item_id"], kind="stable")
        before = self._held()
        held, bins = dict(before), {}
        told: dict[tuple[str | None, int], tuple] = {}
        names = batch["name"].tolist() if "name" in batch else [None] * len(batch)
        columns = *(batch[c].tolist() for c in ("kind", "item_id", "side", "amount")), _nanoseconds(batch["at"]), _nanoseconds(batch["until"])
        for name, kind, item, side, amount, at, until in zip(names, *columns):
            if name not in bins:  # its first row in this batch
                held[name], bins[name] = dict(before.get(name, {})), {}
                for i, v in held[name].items():
                    heapq.heappush(bins[name].setdefault(self._bin(v[1]), {}).setdefault(v[0], []), (v[2], i))
            own, ms = held[name], at // 10**6
            if kind == "snooze":
                if item in own and not own[item][4]:
                    old = own[item]
                    own[item] = (*old[:3], max(old[3], until // 10**6), False)
                continue
            other = self._nearest(bins[name], own, side, amount)
            if other is not None:
                del own[other]
                told[name, item], told[name, other] = (item, "cleared", other, at), (other, "cleared", item, at)
            else:
                own[item] = (side, float(amount), ms, ms + self.after, False)
                heapq.heappush(bins[name].setdefault(self._bin(amount), {}).setdefault(side, []), (ms, item))
                told[name, item] = (item, "open", None, at)
        self._keep(before, held)
        self._wake(_waits(held), _waits(before))
        yield _told(list(told.values()))

    def _nearest(self, bins: dict, held: dict, side: str, amount: float) -> int | None:
        """The earliest open item of the other side within the tolerance; what has left the open items leaves the bins here."""
        found, b = None, self._bin(amount)
        for d in (-1, 0, 1):
            for own, waiting in bins.get(b + d, {}).items():
                if own == side:
                    continue
                is_open = lambda x: x[1] in held and held[x[1]][2] == x[0]
                while waiting and not is_open(waiting[0]):
                    heapq.heappop(waiting)
                near = waiting[:1]
                if near and not abs(held[near[0][1]][1] - amount) <= self.tolerance:
                    near = [x for x in waiting if is_open(x) and abs(held[x[1]][1] - amount) <= self.tolerance]
                found = min([*near, *([found] if found else [])], default=None)
        return found[1] if found else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, told = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        before = self._held()
        held = {name: dict(items) for name, items in before.items()}
        for items in held.values():
            for item, (side, amount, at, due, escalated) in items.items():
                if due <= now and not escalated:
                    items[item] = (side, amount, at, due, True)
                    told.append((item, "escalated", None, due * 10**6))
        self._keep(before, held)
        self._wake(_waits(held), [])
        yield _told(told)


class _WaitingGroup(_Waiting):
    """The same for a group of accounts and references, told apart by ``name``: one value of the state and one timer serve them all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _STATES)

    def _held(self) -> dict[str | None, dict[int, tuple]]:
        held: dict[str | None, dict[int, tuple]] = {}
        for name, item, *v in zip(*(self.open.get() or ())):
            held.setdefault(name, {})[item] = tuple(v)
        return held

    def _keep(self, before: dict[str | None, dict[int, tuple]], held: dict[str | None, dict[int, tuple]]) -> None:
        rows = [(name, item, *v) for name, items in held.items() for item, v in items.items()]
        if rows:
            self.open.update(tuple(map(list, zip(*rows))))
        else:
            self.open.clear()


def _nanoseconds(times: pd.Series) -> list[int]:
    return pd.to_datetime(times).astype("datetime64[ns]").astype("int64").tolist()


def _waits(held: dict[str | None, dict[int, tuple]]) -> list[int]:
    return [v[3] for items in held.values() for v in items.values() if not v[4]]


def _told(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["item_id", "status", "other_id", "at"])
    return out.assign(other_id=out["other_id"].astype("Int64"), at=pd.to_datetime(out["at"].astype("int64")))


def late_counterparts(stream: DataFrame, *, tolerance: float = 0.01, escalate_days: int = 7, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """stream: account_id, ref, kind, item_id, side, amount, at, until. Each item as it changes: open, cleared (by which) or escalated.

    Rows of kind "item" are items of one side ("statement" or "ledger"); one is cleared by the earliest open item of the other side of
    its account and reference whose amount is within ``tolerance``, however often a reference comes. An item that is open
    ``escalate_days`` after its time is escalated once that time is safely past, and may still be cleared. A row of kind "snooze" puts that
    off to ``until``. References are dealt by hash into ``buckets`` groups, whose references are taken through a batch together, as a
    group costs some milliseconds whatever is in it. The state of a group is a list of its open items: what is cleared leaves it.
    """
    name = F.to_json(F.struct("account_id", "ref"))
    rows = stream.select(F.pmod(F.xxhash64("account_id", "ref"), F.lit(buckets)).alias("bucket"), name.alias("name"), "kind", "item_id", "side", "amount", "at", "until")
    return rows.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(_WaitingGroup(tolerance, escalate_days * DAY), OUT, "update", "eventTime")
