"""Narrations taken apart into two texts and a reference, by rules that each account brings along.

The rules are a table of the user's, one row for each thing to look for. The package knows no bank's wording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import text

WIDTH, LONGEST = 41, 400
#: The columns of a rule. ``pattern``'s ``group`` is looked for in ``source`` (narration, own_ref or user_ref) and becomes ``target`` (text_1 or
#: ref). It is asked of rows of ``module`` alone if that is not null, and not of those whose own reference fits ``unless_own``, if that is not.
RULE = ("account", "priority", "source", "pattern", "group", "target", "module", "unless_own")


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def _found(rules: Column, target: str, given: dict[str, Column]) -> Column:
    """What the first rule of a target finds, by priority; null where none finds anything."""

    def hit(r: Column) -> Column:
        source = F.when(r["source"] == "own_ref", given["own_ref"]).when(r["source"] == "user_ref", given["user_ref"]).otherwise(given["narration"])
        asked = (r["target"] == target) & (r["module"].isNull() | (r["module"] == given["module"])) & (r["unless_own"].isNull() | ~F.rlike(given["own_ref"], r["unless_own"]))
        return F.when(asked, F.nullif(F.call_function("regexp_extract", source, r["pattern"], r["group"]), F.lit("")))

    return F.get(F.filter(F.transform(rules, hit), lambda x: x.isNotNull()), F.lit(0))


def extracted(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (account, narration, own_ref, user_ref, module) with text_1, text_2 and ref.

    Accounts with rules: text_1 is what they find, text_2 the whole narration. Others are cut at a fixed width. Blanks are made one.
    """
    listed = rules.groupBy(F.col("account").alias("_account")).agg(F.array_sort(F.collect_list(F.struct("priority", *[c for c in RULE if c not in ("account", "priority")]))).alias("_rules"))
    given = {"narration": _clean(F.col("narration")), "own_ref": text(F.col("own_ref")), "user_ref": text(F.col("user_ref")), "module": F.col("module")}
    both = rows.join(listed, rows["account"] == F.col("_account"), "left")
    ruled, t = F.col("_rules").isNotNull(), given["narration"]
    return both.withColumns(
        {
            "text_1": F.when(ruled, F.coalesce(_found(F.col("_rules"), "text_1", given), F.lit(""))).otherwise(F.substring(t, 1, WIDTH)),
            "text_2": F.when(ruled, F.substring(t, 1, LONGEST)).otherwise(F.substring(t, WIDTH + 1, LONGEST - WIDTH)),
            "ref": _found(F.col("_rules"), "ref", given),
        }
    ).drop("_account", "_rules")
