"""Match tiers: lists of conditions on a pair of rows, compiled to column expressions.

A pair has the statement row's columns under ``l`` and the ledger row's under ``r`` (structs).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import dates, text
from tallyloom.operators.tolerance import DEFAULT, Tolerance, amount_ok, is_asked

#: The ledger type that balances a statement sign.
MIRROR = {"C": "DR", "D": "CR"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Tier:
    number: int
    name: str
    conditions: tuple[Condition, ...]
    auto_confirm: bool = False
    enabled: bool = True
    priority: int | None = None

    @property
    def rank(self) -> int:
        return self.number if self.priority is None else self.priority


def mirrored(sign: Column) -> Column:
    return F.when(sign == "C", MIRROR["C"]).when(sign == "D", MIRROR["D"])


def ref_in_other(l: Column, r: Column, tol: Tolerance) -> Column:
    """The statement's own reference inside the ledger row's narration or references."""
    hit = [text.contains_ref(r[c], l["our_ref"]) for c in ("narration", "external_ref", "trn_ref")]
    return (F.length(text.normalize_ref(l["our_ref"])) >= tol.min_ref_len) & (hit[0] | hit[1] | hit[2])


def ref_symmetric(l: Column, r: Column, tol: Tolerance) -> Column:
    """That, or one of the ledger row's references inside the statement's booking texts."""
    back = F.lit(False)
    for ref in ("trn_ref", "external_ref"):
        long = F.length(F.trim(text.text(r[ref]))) >= tol.min_ref_len
        back = back | (long & (text.contains_ref(l["booking_text_1"], r[ref]) | text.contains_ref(l["booking_text_2"], r[ref])))
    return ref_in_other(l, r, tol) | back


def condition(c: Condition, l: Column, r: Column, tol: Tolerance = DEFAULT) -> Column:
    """One condition; an unknown one never holds."""
    key, p = (c.field, c.op), c.params
    if key == ("amount", "equal_within_tol"):
        return amount_ok(l["amount"], r["amount"], tol, l["rate"] if is_asked(tol.fx_bps) else None)
    if key == ("amount", "exact"):
        return l["amount"] == r["amount"]
    if key == ("value_date", "equal"):
        return (l["value_date"] != 0) & (l["value_date"] == r["value_date"])
    if key == ("value_date", "within_days"):
        return dates.days_between(l["value_date"], r["value_date"]) <= int(p.get("n", 1))
    if key == ("sign", "mirror"):
        return F.coalesce(mirrored(l["sign"]) == r["type"], F.lit(False))
    if key == ("ref", "in_other_narration"):
        return ref_in_other(l, r, tol)
    if key == ("ref", "symmetric_in_narration"):
        return ref_symmetric(l, r, tol)
    if key == ("narration", "contains"):
        wanted = str(p.get("text", "")).upper()
        if not wanted:
            return F.lit(False)
        left = F.contains(F.upper(F.concat_ws(" ", text.text(l["booking_text_1"]), text.text(l["booking_text_2"]))), F.lit(wanted))
        right = F.contains(F.upper(text.text(r["narration"])), F.lit(wanted))
        return {"left": left, "right": right}.get(p.get("side", "either"), left | right)
    if key == ("field", "equal"):
        if not p.get("left") or not p.get("right"):
            return F.lit(False)
        return text.text(l[p["left"]]) == text.text(r[p["right"]])
    return F.lit(False)


def of(number: int, name: str, *conditions: tuple, **options) -> Tier:
    return Tier(number, name, tuple(Condition(*c) for c in conditions), **options)


_SIGN, _REF, _AMOUNT = ("sign", "mirror"), ("ref", "symmetric_in_narration"), ("amount", "equal_within_tol")


def default_tiers(two_sided: bool = True) -> list[Tier]:
    """Reference and amount, reference alone, amount and same day, amount and next day; the last two for two-sided accounts."""
    return [
        of(1, "reference and amount", _SIGN, _AMOUNT, _REF, auto_confirm=True),
        of(2, "reference", _SIGN, _REF),
        of(3, "amount, same day", _SIGN, _AMOUNT, ("value_date", "equal"), enabled=two_sided),
        of(4, "amount, next day", _SIGN, _AMOUNT, ("value_date", "within_days", {"n": 1}), enabled=two_sided),
    ]


def from_json(number: int, name: str, conditions: str, **options) -> Tier:
    return Tier(number, name, tuple(Condition(c["field"], c["op"], c.get("params") or {}) for c in json.loads(conditions)), **options)


def pick(account: list[Tier] | None, kind: list[Tier] | None, fallback: list[Tier]) -> list[Tier]:
    """An account's own tiers replace those of its kind, which replace the built-in ones."""
    return account or kind or fallback


def active(tiers: list[Tier]) -> list[Tier]:
    return sorted((t for t in tiers if t.enabled), key=lambda t: t.rank)


def all_gated_by_ref(tiers: list[Tier]) -> bool:
    """Whether no active tier can match a pair without a shared reference, so that amounts need not be searched."""
    return all(any(c.op == "symmetric_in_narration" for c in t.conditions) for t in active(tiers))


def needs_reference(tier: Tier) -> bool:
    return any(c.op in ("symmetric_in_narration", "in_other_narration") for c in tier.conditions)


def days_apart(tiers: list[Tier]) -> int | None:
    """Days that dates may be apart where an active tier matches a pair without a reference; None without such tiers, or where one sets no bound."""
    bounds = []
    for t in (t for t in active(tiers) if not needs_reference(t)):
        own = [0 if c.op == "equal" else int(c.params.get("n", 1)) for c in t.conditions if c.field == "value_date" and c.op in ("equal", "within_days")]
        if not own or not 0 <= min(own) < dates.FAR:
            return None
        bounds.append(min(own))
    return max(bounds) if bounds else None


#: The columns that each kind of condition reads.
_READS = {"amount": ("amount", "rate"), "value_date": ("value_date",), "sign": ("sign", "type"), "narration": ("booking_text_1", "booking_text_2", "narration"),
          "ref": ("our_ref", "booking_text_1", "booking_text_2", "narration", "external_ref", "trn_ref")}


def columns(tiers: list[Tier]) -> set[str]:
    """The columns of both sides that the active tiers read."""
    conditions = [c for t in active(tiers) for c in t.conditions]
    return {x for c in conditions for x in (*_READS.get(c.field, ()), c.params.get("left"), c.params.get("right")) if x}


def holds(tier: Tier, l: Column, r: Column, tol: Tolerance = DEFAULT, known: Callable[[Condition], Column] | None = None) -> Column:
    """Whether all conditions hold; ``known`` gives columns that have them already."""
    out = F.lit(True)
    for c in tier.conditions:
        out = out & (known(c) if known else condition(c, l, r, tol))
    return out


#: An array of tiers as rows carry it: the active ones in order of their rank.
ROWS = "array<struct<tier:int,tier_name:string,auto_confirm:boolean,conditions:array<struct<field:string,op:string,params:map<string,string>>>>>"


def as_rows(tiers: list[Tier]) -> list[tuple]:
    """The active tiers as a value of :data:`ROWS`."""
    said = lambda p: {k: str(v) for k, v in p.items() if v is not None}
    return [(t.number, t.name, t.auto_confirm, [(c.field, c.op, said(c.params)) for c in t.conditions]) for t in active(tiers)]


@dataclass(frozen=True)
class OfRows:
    """Tiers that left rows carry in a column of type :data:`ROWS`: one expression judges pairs of accounts with any tiers."""

    column: str = "tiers"

    def first(self, l: Column, r: Column, tol: Tolerance, left: list[str], right: list[str]) -> Column:
        """What :func:`first_tier` gives. ``left`` and ``right``: the columns that a condition on equal fields may name."""
        plain = {op: condition(Condition(*op), l, r, tol) for op in _PLAIN}
        days = dates.days_between(l["value_date"], r["value_date"])
        texts = F.upper(F.concat_ws(" ", text.text(l["booking_text_1"]), text.text(l["booking_text_2"]))), F.upper(text.text(r["narration"]))
        named = [F.create_map(*[x for c in names for x in (F.lit(c), text.text(side[c]))]) for side, names in ((l, left), (r, right))]

        def holds(c: Column) -> Column:
            is_ = lambda field, op: (c["field"] == field) & (c["op"] == op)
            p = lambda name: F.coalesce(c["params"][name], F.lit(""))
            side, wanted = p("side"), F.upper(p("text"))
            inside = (side != "right") & F.contains(texts[0], wanted) | (side != "left") & F.contains(texts[1], wanted)
            chain = F.when(is_("value_date", "within_days"), days <= F.coalesce(c["params"]["n"].cast("int"), F.lit(1)))
            chain = chain.when(is_("narration", "contains"), (wanted != "") & inside)
            chain = chain.when(is_("field", "equal"), (p("left") != "") & (p("right") != "") & (F.try_element_at(named[0], p("left")) == F.try_element_at(named[1], p("right"))))
            for (field_, op), ok in plain.items():
                chain = chain.when(is_(field_, op), ok)
            return F.coalesce(chain, F.lit(False))

        return F.get(F.filter(l[self.column], lambda t: F.forall(t["conditions"], holds)), F.lit(0))


_PLAIN = (("amount", "equal_within_tol"), ("amount", "exact"), ("value_date", "equal"), ("sign", "mirror"), ("ref", "in_other_narration"), ("ref", "symmetric_in_narration"))


def staged(tiers: list[Tier]) -> tuple[list[Tier], list[Tier]] | None:
    """The active tiers that need a shared reference and, all after them, those that read but amounts, dates and signs.

    None where tiers are not of this kind: then they cannot be resolved one kind after the other.
    """
    own = active(tiers)
    gated = [t for t in own if any(c.op == "symmetric_in_narration" for c in t.conditions)]
    free = [t for t in own if t not in gated]
    plain = all({c.field for c in t.conditions} <= {"amount", "value_date", "sign"} and any(c.field == "amount" and (c.field, c.op) in _PLAIN for c in t.conditions) for t in free)
    apart = not gated or not free or max(t.number for t in gated) < min(t.number for t in free)
    return (gated, free) if plain and apart and own == gated + free else None


def first_tier(tiers: list[Tier], l: Column, r: Column, tol: Tolerance = DEFAULT, known: Callable[[Condition], Column] | None = None) -> Column:
    """struct(tier, tier_name, auto_confirm) of the first tier that holds, or null."""
    chain = None
    for t in active(tiers):
        value = F.struct(F.lit(t.number).alias("tier"), F.lit(t.name).alias("tier_name"), F.lit(t.auto_confirm).alias("auto_confirm"))
        ok = holds(t, l, r, tol, known)
        chain = F.when(ok, value) if chain is None else chain.when(ok, value)
    return chain if chain is not None else F.lit(None).cast("struct<tier:int,tier_name:string,auto_confirm:boolean>")


def explain(tier: Tier, l: Column, r: Column, tol: Tolerance = DEFAULT) -> list[Column]:
    """A flag for each condition of a tier, for one pair."""
    return [F.coalesce(condition(c, l, r, tol), F.lit(False)).alias(f"c{i}_{c.field}_{c.op}") for i, c in enumerate(tier.conditions, 1)]


def reason(tier: Column, diff: Column, ref: Column) -> Column:
    return (
        F.when(tier == 1, F.format_string("reference %s and amount agree", ref))
        .when(tier == 2, F.format_string("reference %s agrees, amounts differ by %.2f", ref, diff))
        .when(tier == 3, F.lit("amount and value date agree, no reference"))
        .when(tier == 4, F.lit("amount agrees, value dates are one day apart, no reference"))
        .otherwise(F.format_string("tier %d", tier))
    )
