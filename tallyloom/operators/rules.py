"""First-match rules: categories, teams and automatic decisions, as expressions, or by an automaton when they are many."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text

DEFAULT_CATEGORY, DEFAULT_TEAM = "uncategorized", "operations"
EXACT = 0.005


@dataclass(frozen=True)
class Rule:
    """Conditions that are None do not matter; a rule without any fits every item."""

    priority: int
    result: str
    side: str | None = None
    narration: str | None = None
    ref: str | None = None
    kind: str | None = None
    amount_min: float | None = None
    amount_max: float | None = None


def _fits(rule: Rule) -> Column:
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    out = F.lit(True)
    if rule.side is not None:
        out = out & (F.col("side") == rule.side)
    if rule.narration is not None:
        out = out & F.contains(F.upper(text.text(F.col("narration"))), F.lit(rule.narration.upper()))
    if rule.ref is not None:
        out = out & F.contains(F.upper(text.text(F.col("ref"))), F.lit(rule.ref.upper()))
    if rule.kind is not None:
        out = out & (F.upper(text.text(F.col("sign"))) == rule.kind.upper())
    if rule.amount_min is not None:
        out = out & (amount >= rule.amount_min)
    if rule.amount_max is not None:
        out = out & (amount <= rule.amount_max)
    return out


#: Rules up to which one CASE judges them; more are looked up by an automaton over their texts.
CASE_RULES = 64


def _ranked(rules: list[Rule]) -> list[Rule]:
    return [r for _, _, r in sorted((r.priority, i, r) for i, r in enumerate(rules))]


def first_match(items: DataFrame, rules: list[Rule], into: str, default: str) -> DataFrame:
    """``items`` (side, narration, ref, sign, amount) with the result of the first rule by priority, then by place.

    A few rules are one CASE. Of many, all texts that occur in a narration or a reference are found in one pass over it by an
    Aho-Corasick automaton; only rules whose texts occur, and rules without texts, are then judged by their other conditions.
    """
    ranked = _ranked(rules)
    if len(ranked) > CASE_RULES:
        return _by_automaton(items, ranked, into, default)
    chain = None
    for rule in ranked:
        chain = F.when(_fits(rule), F.lit(rule.result)) if chain is None else chain.when(_fits(rule), F.lit(rule.result))
    return items.withColumn(into, chain.otherwise(default) if chain is not None else F.lit(default))


class _Automaton:
    """Ranked rules by their texts. A rule waits at its narration's text, else at its reference's, else among the plain ones."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.plain, self.waiting = rules, [], {"narration": {}, "ref": {}}
        for k, rule in enumerate(rules):
            at = "narration" if rule.narration else "ref" if rule.ref else None
            (self.waiting[at].setdefault(getattr(rule, at).upper(), []) if at else self.plain).append(k)
        self.finders = None

    def __getstate__(self):
        return self.__dict__ | {"finders": None}  # built once on each worker

    def _finder(self, texts: dict[str, list[int]]):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, ks in texts.items():
            found.add_word(t, ks)
        if texts:
            found.make_automaton()
        return found if texts else None

    def best(self, batch: pa.RecordBatch) -> np.ndarray:
        """The place of each row's first rule that fits, or the number of rules."""
        if self.finders is None:
            self.finders = {at: self._finder(texts) for at, texts in self.waiting.items()}
        side, kind, narration, ref = (batch.column(c).to_pylist() for c in ("side", "kind", "narration", "ref"))
        amount = batch.column("amount").to_numpy(zero_copy_only=False)
        out = np.full(batch.num_rows, len(self.rules))
        if self.plain:
            sides, kinds, open_ = np.array(side, object), np.array(kind, object), np.ones(batch.num_rows, bool)
            for k in self.plain:
                r = self.rules[k]
                ok = open_.copy()
                if r.side is not None:
                    ok &= sides == r.side
                if r.kind is not None:
                    ok &= kinds == r.kind.upper()
                if r.amount_min is not None:
                    ok &= amount >= r.amount_min
                if r.amount_max is not None:
                    ok &= amount <= r.amount_max
                out[ok], open_ = k, open_ & ~ok
                if not open_.any():
                    break
        for at, texts in (("narration", narration), ("ref", ref)):
            finder = self.finders[at]
            if finder is None:
                continue
            for i, t in enumerate(texts):
                for _, ks in finder.iter(t):
                    for k in ks:
                        if k >= out[i]:
                            break
                        r = self.rules[k]
                        if (
                            (r.side is None or side[i] == r.side) and (r.kind is None or kind[i] == r.kind.upper())
                            and (r.amount_min is None or amount[i] >= r.amount_min) and (r.amount_max is None or amount[i] <= r.amount_max)
                            and (at == "ref" or not r.ref or r.ref.upper() in ref[i])
                        ):
                            out[i] = k
                            break
        return out


def _by_automaton(items: DataFrame, ranked: list[Rule], into: str, default: str) -> DataFrame:
    # Spark orders NaN above all numbers, numpy does not: a NaN amount is told as infinity, a null one is 0 as in the CASE
    amount = F.coalesce("amount", F.lit(0.0)).cast("double")
    told = F.struct(
        F.col("side").cast("string").alias("side"), F.upper(text.text(F.col("sign"))).alias("kind"), F.upper(text.text(F.col("narration"))).alias("narration"),
        F.upper(text.text(F.col("ref"))).alias("ref"), F.when(F.isnan(amount), float("inf")).otherwise(amount).alias("amount"),
    )
    automaton = _Automaton(ranked)

    results = list(dict.fromkeys([r.result for r in ranked] + [default]))
    place = {x: i for i, x in enumerate(results)}
    to = np.array([place[r.result] for r in ranked] + [place[default]], np.int32)

    @F.arrow_udf("int")
    def result(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in rows:
            yield pa.array(to[automaton.best(pa.RecordBatch.from_struct_array(part))])

    return items.withColumn(into, F.get(F.array(*map(F.lit, results)), result(told)))


def backfill(items: DataFrame, rules: list[Rule], into: str, default: str) -> DataFrame:
    """Only where ``into`` is null."""
    found = first_match(items, rules, "_found", default)
    return found.withColumn(into, F.coalesce(into, "_found")).drop("_found")


def auto_match(pending: DataFrame, rules: DataFrame) -> DataFrame:
    """Each pending assignment with the first automatic rule that holds, or without (rule null); equal rows stay as many.

    pending: id columns and tier, amount_diff, l_ref, l_their_ref, r_ref, l_date, r_date; rules: rule_id, priority, require_tier,
    require_amount_exact, max_amount_diff, require_ref_match, require_same_date; null requirements do not matter. A null
    difference is 0, dates that are both missing agree. References agree if the ledger's is there and one of it and the
    statement's two holds the other as written, case and outer blanks aside; an empty statement reference is held by any.

    The rules are one row, an array in order of (priority, rule_id), that goes to every task: they are configuration.
    """
    ref = lambda c: F.upper(F.trim(text.text(F.col(c)))) if c in pending.columns else F.lit("")
    ours, theirs, booked = ref("l_ref"), ref("l_their_ref"), ref("r_ref")
    refs_agree = (booked != "") & (F.contains(ours, booked) | F.contains(theirs, booked) | F.contains(booked, ours) | F.contains(booked, theirs))
    same_day = F.coalesce("l_date", F.lit(0)) == F.coalesce("r_date", F.lit(0))
    gap = F.abs(F.coalesce("amount_diff", F.lit(0.0)))
    wants = ("require_tier", "require_amount_exact", "max_amount_diff", "require_ref_match", "require_same_date")
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("priority", "rule_id", *wants))).alias("_rules"))
    not_asked = lambda c: ~F.coalesce(c, F.lit(False))

    def holds(r: Column) -> Column:
        return (
            (r["require_tier"].isNull() | (F.col("tier") == r["require_tier"])) & (not_asked(r["require_amount_exact"]) | (gap <= EXACT)) & (r["max_amount_diff"].isNull() | (gap <= r["max_amount_diff"]))
            & (not_asked(r["require_ref_match"]) | F.col("_refs")) & (not_asked(r["require_same_date"]) | F.col("_day"))
        )

    rows = pending.withColumn("_refs", refs_agree).withColumn("_day", same_day).crossJoin(F.broadcast(listed))
    return rows.withColumn("rule", F.get(F.filter("_rules", holds), F.lit(0))["rule_id"]).drop("_refs", "_day", "_rules")
