"""One-to-many, many-to-one and many-to-many matches among rows that one-to-one matching left over.

Subsets are searched inside Arrow functions. One-to-many pools are the rows of one reference and of references connected to
it; a pool of n rows is searched by sorted sums of pairs, in some n * n steps. Many-to-many pools are the rows of a few days
of a session, of which larger ones are not searched at all (``POOL``), which is the operator's rule and not a cut of its
input; a group is a run of days of one session whose pools share rows, so it holds at most ``2 * POOL`` rows a day.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import tiers as T
from tallyloom.operators.components import components
from tallyloom.operators.store import written
from tallyloom.operators.tolerance import DEFAULT, OfRows, Tolerance, number

MAX_SUBSET, POOL, SIDE = 4, 20, 3
MIN_KEY = 4
#: Amounts of which all combinations are tried.
FEW = 6
#: Characters up to which keys are looked up whole in others.
WHOLE = 64
_OUT = "session_id long, l_rows array<long>, r_rows array<long>, tier int, amount_diff double"


def _close(total: float, target: float, tol: Tolerance) -> bool:
    gap = abs(total - target)
    return gap <= tol.amount_abs or (tol.amount_pct > 0 and gap / max(abs(total), abs(target), 1.0) * 100 <= tol.amount_pct)


def _near(totals: np.ndarray, target: float, tol: Tolerance) -> np.ndarray:
    gap = np.abs(totals - target)
    ok = gap <= tol.amount_abs
    return ok | (gap / np.maximum(np.maximum(np.abs(totals), abs(target)), 1.0) * 100 <= tol.amount_pct) if tol.amount_pct > 0 else ok


def first_subset(amounts: list[float], target: float, tol: Tolerance) -> list[int] | None:
    """The first combination of two to four places, in order of size and then of places, whose sum is close to ``target``.

    Two amounts of a combination are given; the others are looked up among sorted amounts or sorted sums of two. Of few amounts
    all combinations are tried.
    """
    n = len(amounts)
    if n < 2:
        return None
    if n <= FEW:
        choices = (places for size in range(2, MAX_SUBSET + 1) for places in combinations(range(n), size))
        return next((list(places) for places in choices if _close(sum(amounts[p] for p in places), target, tol)), None)
    a = np.asarray(amounts, float)
    share = min(tol.amount_pct / 100, 0.99)
    reach = max(tol.amount_abs, share / (1 - share) * max(abs(target), 1.0)) + 1e-9 * (1 + abs(target) + float(np.abs(a).sum()))
    fits = lambda places: _close(sum(amounts[p] for p in places), target, tol)
    by = np.argsort(a, kind="stable")
    one = a[by]

    def beyond(base: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which of ``base`` have some sorted value at the right distance."""
        return np.searchsorted(values, target - base - reach) < np.searchsorted(values, target - base + reach, "right")

    for i in np.flatnonzero(beyond(a, one)).tolist():
        near = by[np.searchsorted(one, target - a[i] - reach) : np.searchsorted(one, target - a[i] + reach, "right")]
        for j in np.sort(near[near > i]).tolist():
            if fits((i, j)):
                return [i, j]
    if n < 3 or MAX_SUBSET < 3:
        return None
    first, second = np.triu_indices(n, 1)
    two = a[first] + a[second]
    for at in np.flatnonzero(beyond(two, one)).tolist():
        i, j = int(first[at]), int(second[at])
        near = by[np.searchsorted(one, target - two[at] - reach) : np.searchsorted(one, target - two[at] + reach, "right")]
        for k in np.sort(near[near > j]).tolist():
            if fits((i, j, k)):
                return [i, j, k]
    if n < 4 or MAX_SUBSET < 4:
        return None
    order = np.argsort(two, kind="stable")
    sums = two[order]
    for at in np.flatnonzero(beyond(two, sums)).tolist():
        i, j = int(first[at]), int(second[at])
        near = order[np.searchsorted(sums, target - two[at] - reach) : np.searchsorted(sums, target - two[at] + reach, "right")]
        for p in np.sort(near[first[near] > j]).tolist():  # places of pairs are in their order
            if fits((i, j, int(first[p]), int(second[p]))):
                return [i, j, int(first[p]), int(second[p])]
    return None


def _pieces(key: Column, n: Column) -> Column:
    """All different pieces of ``n`` characters, of which the key has at least one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substring(key, i, n)))


def contained_keys(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of unequal keys of one session and type of which the first lies inside the second: (them, what was compared).

    keys: distinct session_id, type, key. A key is cut into its pieces of each length that shorter keys of its session have, and
    these are joined with whole keys: what meets is contained, whatever prefixes a bank's references share and however many they
    are. Where all keys are of one length nothing is cut. Keys longer than ``WHOLE`` are looked up by their rarest piece of
    that length, counted over all keys first, and compared; keys that cannot be longer than another are not cut.
    """
    of = ["session_id", "type"]
    size = F.length("key")
    keys = keys.where(size > 0)
    lengths = keys.groupBy(*of).agg(F.array_sort(F.collect_set(F.least(size, F.lit(WHOLE)))).alias("lengths"))  # at most WHOLE numbers each
    shorter = F.filter("lengths", lambda n: (n < size) & (n < WHOLE))
    outer = keys.join(lengths, of).select(*of, F.col("key").alias("outer"), F.explode(shorter).alias("n"))
    cut = outer.select(*of, "outer", F.explode(_pieces(F.col("outer"), F.col("n"))).alias("inner"))
    found = cut.join(keys.withColumnRenamed("key", "inner"), [*of, "inner"]).select(*of, "inner", "outer")

    long = keys.where(size >= WHOLE)
    pieces = long.select(*of, "key", F.explode(_pieces(F.col("key"), F.lit(WHOLE))).alias("g"))
    counts = pieces.groupBy(*of, "g").agg(F.count("*").alias("n")).where("n > 1")  # a key with a piece that no other has lies in none
    rarest = pieces.join(counts, [*of, "g"]).groupBy(*of, "key").agg(F.min(F.struct("n", "g"))["g"].alias("g"), F.count("*").alias("known"))
    inner = rarest.where(F.col("known") == F.size(_pieces(F.col("key"), F.lit(WHOLE)))).select(*of, F.col("key").alias("inner"), "g")
    near = inner.join(pieces.withColumnRenamed("key", "outer"), [*of, "g"]).where(F.length("outer") > F.length("inner")).select(*of, "inner", "outer")
    return found.unionByName(near.where(F.contains("outer", F.col("inner")))), found.unionByName(near)


def _grouped(one: DataFrame, many: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    """session_id, type, c, side (0: of many), key, row, amount, SHARES: the rows that may take part, and the group ``c`` of each.

    Pools are the rows whose keys are equal to a row's key, contain it or lie inside it. Keys that are so related, directly or
    over others, are a group: the smallest of its keys names it, and a key related to no other is a group by itself.
    """
    of = ["session_id", "type"]
    least = F.greatest(F.lit(MIN_KEY), tol.at(F.col).min_ref_len if tol.columns else F.lit(tol.min_ref_len))
    o = one.where("type is not null").withColumns({"side": F.lit(1), "least": least})
    m = many.where("type is not null").withColumns({"side": F.lit(0), "least": F.lit(MIN_KEY)})
    rows = written(_with_shares(o.unionByName(m), tol).select(*of, "side", "key", "row", "amount", "least", *SHARES), "split-rows")
    rows = rows.where(F.length("key") >= F.col("least")).drop("least")  # not before keys are computed: each use of one would compute it again
    keys = written(rows.groupBy(*of, "key").agg(F.max(F.col("side") == 1).alias("o"), F.max(F.col("side") == 0).alias("m")), "split-keys")
    pairs, _ = contained_keys(keys.select(*of, "key"))
    roles = lambda name: keys.select(*of, F.col("key").alias(name), F.struct("o", "m").alias(f"{name}_at"))
    linked = pairs.join(roles("inner"), [*of, "inner"]).join(roles("outer"), [*of, "outer"]).where("inner_at.o and outer_at.m or inner_at.m and outer_at.o")
    node = lambda c: F.struct(*of, F.col(c).alias("key"))
    groups = components(linked.select(node("inner").alias("a"), node("outer").alias("b")), "a", "b").select("node.*", F.col("component.key").alias("c"))
    both = keys.join(groups, [*of, "key"], "left").where("c is not null or o and m")  # a key of one side alone has no pool
    return rows.join(both.select(*of, "key", F.coalesce("c", "key").alias("c")), [*of, "key"])


def _claimed(one: DataFrame, many: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    """session_id, o, ms, gap: in order of ``o``, each takes the first subset (in size and order of rows) of its free rows that meets its amount.

    Claims reach only as far as pools share rows, which is a group at most. Rows travel once each; the pools of a group are put
    together where they are searched.
    """
    schema = pa.schema([("session_id", pa.int64()), ("o", pa.int64()), ("ms", pa.list_(pa.int64())), ("gap", pa.float64())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("session_id", "type", "c", "side", "key", "row", "amount", *SHARES))))
        out = []
        for (session, _, _), group in groupby(rows, key=lambda r: r[:3]):
            held, pools, used = {}, {}, set()
            for *_, side, key, row, amount, share_abs, share_pct in group:  # first the rows of many
                if not side:
                    held.setdefault(key, []).append((row, amount))
                    continue
                if key not in pools:
                    pools[key] = sorted(x for k, xs in held.items() if k == key or k in key or key in k for x in xs)
                free = [x for x in pools[key] if x[0] not in used]
                hit = first_subset([a for _, a in free], amount, Tolerance(share_abs, share_pct)) if len(free) > 1 else None
                if hit:
                    used.update(free[p][0] for p in hit)
                    out.append({"session_id": session, "o": row, "ms": [free[p][0] for p in hit], "gap": sum(free[p][1] for p in hit) - amount})
                if len(out) == 10000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    rows = _grouped(one, many, tol).repartition("session_id", "type", "c").sortWithinPartitions("session_id", "type", "c", "side", "row")
    return rows.select("session_id", "type", "c", "side", "key", "row", "amount", *SHARES).mapInArrow(take, "session_id long, o long, ms array<long>, gap double")


#: The tolerances of sums, as rows carry them to where subsets are searched.
SHARES = ("share_abs", "share_pct")


def _with_shares(rows: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    own = tol.at(F.col)
    return rows.withColumns({"share_abs": number(own.amount_abs), "share_pct": number(own.amount_pct)})


def _left(left: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    return left.select("session_id", F.col("row_number").alias("row"), T.mirrored(F.col("sign")).alias("type"), text.normalize_ref(F.col("our_ref")).alias("key"), "amount", *tol.columns)


def _right(right: DataFrame, tol: Tolerance | OfRows) -> DataFrame:
    key = F.when(F.length(text.normalize_ref(F.col("trn_ref"))) >= MIN_KEY, text.normalize_ref(F.col("trn_ref"))).otherwise(text.normalize_ref(F.col("external_ref")))
    return right.select("session_id", F.col("row_number").alias("row"), "type", key.alias("key"), "amount", *tol.columns)


def one_to_many(left: DataFrame, right: DataFrame, tol: Tolerance | OfRows = DEFAULT) -> DataFrame:
    """session_id, l_rows, r_rows, tier 5, amount_diff: a statement row against two to four ledger rows."""
    found = _claimed(_left(left, tol), _right(right, tol), tol)
    return found.select("session_id", F.array("o").alias("l_rows"), F.col("ms").alias("r_rows"), F.lit(5).alias("tier"), F.col("gap").alias("amount_diff"))


def many_to_one(left: DataFrame, right: DataFrame, tol: Tolerance | OfRows = DEFAULT, taken: DataFrame | None = None) -> DataFrame:
    """A ledger row against two to four statement rows; rows that ``taken`` one-to-many matches hold are left out."""
    r = _right(right, tol)
    if taken is not None:
        r = r.join(taken.select("session_id", F.explode("r_rows").alias("row")), ["session_id", "row"], "left_anti")
    found = _claimed(r, _left(left, tol), tol)
    return found.select("session_id", F.col("ms").alias("l_rows"), F.array("o").alias("r_rows"), F.lit(5).alias("tier"), (-F.col("gap")).alias("amount_diff"))


def many_to_many(left: DataFrame, right: DataFrame, tol: Tolerance | OfRows = DEFAULT) -> DataFrame:
    """session_id, l_rows, r_rows, tier 6: two or three rows of each side whose sums agree within a band of days.

    For each left date, in order, the rows of both sides within the band form a pool; a pool of more than ``POOL`` rows
    on a side is not searched. Claims go on from date to date as long as pools share rows, so a group is a run of dates that
    are at most two bands apart; rows in no searchable pool are left out before.
    """
    days = tol.at(F.col).days
    band = F.greatest(days if isinstance(days, Column) else F.lit(days), F.lit(1)).alias("band")
    left, right = _with_shares(left, tol), _with_shares(right, tol)
    day = lambda c: F.unix_date(F.try_to_date(c.cast("string"), "yyyyMMdd"))
    l = left.where("value_date <> 0").select("session_id", F.lit("l").alias("at"), F.col("row_number").alias("row"), "amount", F.when(F.col("sign") == "C", "DR").when(F.col("sign") == "D", "CR").alias("type"), day(F.col("value_date")).alias("day"), band, *SHARES)
    r = right.where("value_date <> 0").select("session_id", F.lit("r").alias("at"), F.col("row_number").alias("row"), "amount", "type", day(F.col("value_date")).alias("day"), band, *SHARES)
    both = l.unionByName(r)
    near = both.select("session_id", "at", "row", "band", F.explode(F.sequence(F.col("day") - F.col("band"), F.col("day") + F.col("band"))).alias("anchor"))
    sizes = near.groupBy("session_id", "anchor", "band").agg(F.count_if(F.col("at") == "l").alias("nl"), F.count_if(F.col("at") == "r").alias("nr"))
    anchors = sizes.where(f"nl between 2 and {POOL} and nr between 2 and {POOL}").join(l.select("session_id", F.col("day").alias("anchor")).distinct(), ["session_id", "anchor"], "left_semi")
    days = Window.partitionBy("session_id").orderBy("anchor")
    begins = F.coalesce((F.col("anchor") - F.lag("anchor").over(days) > 2 * F.col("band")).cast("int"), F.lit(0))
    runs = anchors.select("session_id", "anchor", begins.alias("begins")).withColumn("run", F.sum("begins").over(days)).drop("begins")
    pools = near.drop("band").join(runs, ["session_id", "anchor"]).join(both, ["session_id", "at", "row"])

    def search(left: list[tuple[int, float]], right: list[tuple[int, float]], used: set[tuple[str, int]], tol: Tolerance) -> Iterator[tuple[list[int], list[int], float]]:
        """The matches of one pool, in order of left combinations; each claims its rows."""
        amounts = np.array([a for _, a in right])
        tuples = [np.array(list(combinations(range(len(right)), n)), int).reshape(-1, n) for n in range(2, SIDE + 1)]
        sums = [amounts[t].sum(axis=1) if len(t) else np.zeros(0) for t in tuples]
        # left combinations that no right sum is near are left out before; claims only make hits fewer
        every = np.sort(np.concatenate(sums))
        reach = max(tol.amount_abs, tol.amount_pct / 100 * (2 * sum(abs(a) for _, a in left + right) + 1)) + 1e-6
        free = np.array([("r", i) not in used for i, _ in right], bool)
        for m in range(2, SIDE + 1):
            choices = list(combinations(left, m))
            totals = np.array([sum(a for _, a in ls) for ls in choices])
            near = np.searchsorted(every, totals - reach) < np.searchsorted(every, totals + reach, "right") if choices else []
            for k in np.flatnonzero(near).tolist():
                ls, total = choices[k], sum(a for _, a in choices[k])
                if any(("l", i) in used for i, _ in ls):
                    continue
                for t, s in zip(tuples, sums):
                    hit = np.flatnonzero(_near(s, total, tol) & free[t].all(axis=1)) if len(t) else t
                    if len(hit):
                        rs = [right[j] for j in t[hit[0]]]
                        free[t[hit[0]]] = False
                        used.update([("l", i) for i, _ in ls] + [("r", i) for i, _ in rs])
                        yield [i for i, _ in ls], [i for i, _ in rs], sum(a for _, a in rs) - total
                        break

    schema = pa.schema([("session_id", pa.int64()), ("l_rows", pa.list_(pa.int64())), ("r_rows", pa.list_(pa.int64())), ("tier", pa.int32()), ("amount_diff", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pools in order of session, run, date and row; what is claimed is kept for one run."""
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("session_id", "run", "anchor", "row", "at", "type", "amount", *SHARES))))
        group, used, out = None, set(), []
        for (session, run, _), pool in groupby(rows, key=lambda x: x[:3]):
            if (session, run) != group:
                group, used = (session, run), set()
            sides: dict[tuple[str, str], list[tuple[int, float]]] = {}
            for *_, row, at, kind, amount, share_abs, share_pct in pool:
                sides.setdefault((at, kind), []).append((row, amount))
            for kind in ("DR", "CR"):
                left, right = sides.get(("l", kind), []), sides.get(("r", kind), [])
                if min(len(left), len(right)) >= 2:
                    out += [{"session_id": session, "l_rows": ls, "r_rows": rs, "tier": 6, "amount_diff": gap} for ls, rs, gap in search(left, right, used, Tolerance(share_abs, share_pct))]
            if len(out) >= 10000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    ordered = pools.repartition("session_id", "run").sortWithinPartitions("session_id", "run", "anchor", "row", "at")
    return ordered.select("session_id", "run", "anchor", "row", "at", "type", "amount", *SHARES).mapInArrow(find, _OUT)


def persisted(found: DataFrame) -> DataFrame:
    """One pending assignment per row of the larger side (all pairs where both have several), with a shared group id."""
    n = F.greatest(F.size("l_rows"), F.size("r_rows"))
    group = F.substring(F.sha2(F.concat_ws("|", "session_id", F.concat_ws(",", F.transform("l_rows", lambda x: x.cast("string"))), F.concat_ws(",", F.transform("r_rows", lambda x: x.cast("string")))), 256), 1, 12)
    rows = found.select("session_id", "tier", (F.col("amount_diff") / n).alias("amount_diff"), group.alias("split_group_id"), F.explode("l_rows").alias("l_row"), "r_rows")
    return rows.select("session_id", "tier", "amount_diff", "split_group_id", "l_row", F.explode("r_rows").alias("r_row"), F.lit("pending").alias("status"), F.lit("split").alias("source"))
