"""Card reconciliation: records of several stages grouped by the scheme's reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("auth", "clearing", "settlement")
PROTECTED = ("disputed", "written_off")
ORDER = ("mismatched", "incomplete", "matched", "unmatched")
EPSILON = 1e-9


def groups(records: DataFrame, tolerance: float = 0.01, required: tuple[str, ...] = STAGES, more: Sequence[Column] = ()) -> DataFrame:
    """scheme_ref, records, files, lowest, highest, total, stages, the aggregates ``more``, spread, status.

    One file alone is unmatched; a spread above the tolerance is mismatched; a missing stage makes a group incomplete.
    """
    rows = records.where("scheme_ref is not null and scheme_ref <> ''")
    agg = rows.groupBy("scheme_ref").agg(
        F.count("*").alias("records"),
        F.countDistinct("file_id").alias("files"),
        F.min("amount").alias("lowest"),
        F.max("amount").alias("highest"),
        F.sum("amount").alias("total"),
        F.array_sort(F.collect_set("stage")).alias("stages"),
        *more,
    )
    spread = F.col("highest") - F.col("lowest")
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), "stages")) if required else F.lit(0)
    status = F.when(F.col("files") <= 1, "unmatched").when(spread > tolerance + EPSILON, "mismatched").when(missing > 0, "incomplete").otherwise("matched")
    return agg.withColumn("spread", spread).withColumn("status", status)


def ordered(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    return found.orderBy(rank, F.desc("spread"), "scheme_ref")


def written_back(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with their group's status, except those that an operator has set."""
    rows = records.join(found.select("scheme_ref", F.col("status").alias("_s")), "scheme_ref", "left")
    new = F.when(F.col("recon_status").isin(*PROTECTED) | F.col("_s").isNull(), F.col("recon_status")).otherwise(F.col("_s"))
    return rows.withColumn("recon_status", new).withColumn("matched", F.col("recon_status") == "matched").drop("_s")
