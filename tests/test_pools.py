"""Split pools by contained keys, components, rules by automaton: against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import rules, splits
from tallyloom.operators.components import components
from tallyloom.operators.tolerance import Tolerance
from tallyloom.plans import ledgers

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("one_task", [0, 1 << 18])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape, one_task):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)],
        "chain": [(i, i + 1) for i in range(200)] + [(1000, 1000)],
        "star": [(500, i) for i in range(400)] + [(7000, 7001)],
        "none": [],
    }[shape]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame([((1, a), (1, b)) for a, b in edges], "a struct<s:int,i:long>, b struct<s:int,i:long>"), "a", "b", one_task).collect()
    assert sorted((r.node.i, r.component.i) for r in got) == sorted((x, top(x)) for x in root)


def claims(one, many, tol):
    """Rows (session, row, type, key, amount): each of one, in order, takes the first subset of its pool."""
    out, used = [], set()
    for s, row, kind, key, amount in sorted(one):
        if len(key) < max(tol.min_ref_len, 4):
            continue
        pool = sorted((r, a) for t, r, k, m, a in many if (t, k) == (s, kind) and len(m) >= 4 and (m in key or key in m) and (s, r) not in used)
        hit = splits.first_subset([a for _, a in pool], amount, tol)
        if hit:
            used |= {(s, pool[p][0]) for p in hit}
            out.append((s, row, [pool[p][0] for p in hit]))
    return out


def test_pools_of_contained_keys_equal_brute_force(spark):
    rng = random.Random(6)
    keys = [f"FT24{rng.randrange(40):04d}" for _ in range(30)]
    keys += [k + rng.choice(["X", "-9", ""]) for k in keys[:12]] + [k[2:] for k in keys[12:20]] + [k[4:] for k in keys[20:24]] + ["FT24", "AAAA", "AAAAAAAA", "abc"]
    left = [(s, 100 * s + i, 20240105, float(rng.choice([3, 5, 7, 9])), rng.choice("CD"), rng.choice(keys)) for s in range(3) for i in range(60)]
    right = [(s, 100 * s + i, 20240105, float(rng.choice([1, 2, 3, 4])), rng.choice(["DR", "CR"]), rng.choice(keys), rng.choice(["", "FT240001"])) for s in range(3) for i in range(90)]
    a = spark.createDataFrame(left, "session_id long, row_number long, value_date int, amount double, sign string, our_ref string")
    b = spark.createDataFrame(right, "session_id long, row_number long, value_date int, amount double, type string, trn_ref string, external_ref string")
    tol = Tolerance(min_ref_len=4)
    norm = lambda t: t.replace("-", "").upper().lstrip("0")
    one = [(s, i, {"C": "DR", "D": "CR"}[g], norm(k), x) for s, i, _, x, g, k in left]
    many = [(s, i, t, norm(k) if len(norm(k)) >= 4 else norm(e), x) for s, i, _, x, t, k, e in right]
    got = [(r.session_id, r.l_rows[0], r.r_rows) for r in splits.one_to_many(a, b, tol).collect()]
    assert sorted(got) == sorted(claims(one, many, tol)) and got


def test_containment_compares_few_pairs(spark):
    """Keys that share a prefix, as a bank's references do: what is compared stays near what is contained or equal."""
    rows = spark.range(20000).select(F.lit(1).alias("session_id"), F.lit("DR").alias("type"), F.concat(F.lit("FT24"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("key"))
    rows = rows.unionByName(rows.where("key like '%7'").withColumn("key", F.concat("key", F.lit("-1"))))
    pairs, compared = splits.contained_keys(rows)
    assert pairs.count() == 2000 and compared.count() < 10 * (2000 + rows.count())


@pytest.mark.parametrize("n", [60, 300])
def test_many_rules_equal_one_case(spark, monkeypatch, n):
    rng = random.Random(n)
    words = ["fee", "FEE charge", "ab", "b", "\u00df", "wire", "a"]
    some = [
        rules.Rule(rng.randrange(20), f"r{rng.randrange(50)}", rng.choice([None, "statement", "ledger"]), rng.choice([None, "", *words]), rng.choice([None, None, "7", "12"]), rng.choice([None, None, "dr"]), rng.choice([None, 3.0]), rng.choice([None, 9.0]))
        for _ in range(n)
    ]
    some = [r for r in some if r.narration or r.ref or r.kind]
    items = [(i, rng.choice(["statement", "ledger", None]), " ".join(rng.choices(words, k=2)) if i % 9 else None, str(rng.randrange(300)), rng.choice(["DR", "dr", "CR", None]), rng.choice([None, 1.0, 5.0, 20.0, float("nan")])) for i in range(400)]
    df = spark.createDataFrame(items, "i int, side string, narration string, ref string, sign string, amount double")
    monkeypatch.setattr(rules, "CASE_RULES", 10**6)
    want = sorted(map(tuple, rules.first_match(df, some, "found", "none").select("i", "found").collect()))
    monkeypatch.setattr(rules, "CASE_RULES", 0)
    got = sorted(map(tuple, rules.first_match(df, some, "found", "none").select("i", "found").collect()))
    assert got == want and len({f for _, f in got}) > 3


def test_ten_thousand_rules(spark):
    got = ledgers.Q["categorize_many_rules"](spark, SMALL)
    assert got.count() == got.select("item_id").distinct().count() and got.where("found <> 'uncategorized'").count() > 0
