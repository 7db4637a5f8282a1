"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. The words a source may give beyond whole epochs are a budget; the documents whose
hash lies below the source's threshold spend it. Thresholds are found without sorting: a histogram of words by source
and 12 hash bits gives the bucket where the budget ends, and only that bucket is counted again by the next 12 bits,
down to single hashes. Of the rows that share the boundary hash (they have the same id and text, or are one row) as
many give a copy more as leave the sum nearest to the budget.

Sizes are read from whole texts once and written to the shared folder; each refinement reads a narrower part of that
table. A source with a third of all rows is summed before the exchange like any other.

Nulls: a null text has size 0, null is a source of its own after all others; null ids are hashed by their text.
Repeated rows share a hash and differ only at the boundary, where the first ones of the written table give more. Documents
without words are taken as often as the whole epochs of their source. Very long texts are measured whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import own_names, written

#: Whole copies of a source that a mix may hold at most.
MAX_EPOCHS = 3
#: Words: maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
CYCLE = (1, 2, 3)


def _hash(doc_id: str = "doc_id", text: str = "text"):
    """60 bits from the id and the text; MD5, so that other engines can compute it too."""
    whole = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    rows = own_names(docs, doc_id=id_col, text=text_col, source=source_col)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(rows.select("doc_id", "source", size.alias("size"), _hash().alias("h")), "mix-sizes")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. One row per source: a set of labels, summed before this runs in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    per = per.withColumn("weight", F.element_at(weights, (F.pmod(place - 1, F.lit(len(cycle))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    # sources in the order in which a rising level w * x meets their caps: the first that stays below its cap sets the level
    order = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("cap").cast("double") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    per = per.withColumn("level", F.coalesce(F.min(fits).over(every)["level"], F.lit(0.0)))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, epochs (whole copies of all); one copy more where the hash is below ``bound``, and for ``extra`` of the equal rows at it."""
    share = F.col("target") / F.col("source_size")
    epochs = F.when(F.col("source_size") > 0, F.floor(share)).otherwise(0).cast("long")
    edge = goals.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    edge = edge.withColumn("open", F.col("left") > 0)  # without a budget no document gives a copy more
    edge = written(edge.withColumn("prefix", F.lit(0).cast("long")).withColumn("extra", F.lit(0).cast("long")), "mix-edge")
    inside = sizes
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        e = edge.where("open").select(F.col("source").alias("s"), "prefix", "left")
        inside = inside.join(
            e.select("s", "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", shift + BITS) == F.col("prefix")),
            "left_semi",
        )
        bars = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("bar")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = Window.partitionBy("source").orderBy("bar")  # at most 2 ** BITS bars of a source
        bars = bars.withColumn("sum", F.sum("n").over(upto)).join(e, F.col("source").eqNullSafe(F.col("s")))
        cut = bars.where(F.col("sum") > F.col("left")).groupBy("s").agg(F.min(F.struct("bar", "sum", "n", "rows")).alias("cut"))
        nxt = edge.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
        spent = F.col("cut.sum") - F.col("cut.n")
        some = F.floor((F.col("left") - spent) / (F.col("cut.n") / F.col("cut.rows")) + 0.5)
        last = F.lit(level == LEVELS)
        # an open source without a cut takes the whole of its bucket: its bound is the bucket's end
        nxt = nxt.select(
            "source",
            "source_size",
            "target",
            "epochs",
            F.when(F.col("open") & F.col("cut").isNotNull(), F.col("left") - spent).otherwise(F.col("left")).alias("left"),
            F.when(F.col("open") & F.col("cut").isNotNull(), F.col("cut.bar") + (last & (some >= F.col("cut.rows"))).cast("long"))
            .when(F.col("open"), F.shiftleft(F.col("prefix") + 1, BITS))
            .otherwise(F.shiftleft("prefix", BITS))
            .alias("prefix"),
            (F.col("open") & F.col("cut").isNotNull()).alias("open"),
            F.when(last & F.col("open") & (some < F.col("cut.rows")), some).otherwise(F.col("extra")).cast("long").alias("extra"),
        )
        edge = written(nxt, "mix-edge")
    return edge.select("source", "source_size", "target", "epochs", F.col("prefix").alias("bound"), "extra")


def _bounded(sizes: DataFrame) -> DataFrame:
    return thresholds(sizes, targets(sizes))


def _copies(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """``rows`` (with h and source) with epochs and ``copies``.

    If equal rows at a boundary are split, they are numbered by the partition that reads them, and the partitions by their counts.
    """
    whole, edge = F.col("epochs"), edge.withColumnRenamed("source", "s")
    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    if edge.where("extra > 0").isEmpty():
        return rows.withColumn("copies", (whole + (F.col("h") < F.col("bound")).cast("long")).cast("int"))
    rest = rows.where(F.coalesce((F.col("h") != F.col("bound")) | (F.col("extra") == 0), F.lit(True)))
    rest = rest.withColumn("copies", (whole + (F.col("h") < F.col("bound")).cast("long")).cast("int"))
    at = rows.where((F.col("h") == F.col("bound")) & (F.col("extra") > 0))
    at = written(at.withColumn("pid", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "mix-boundary")
    parts = at.groupBy("source", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("s"), F.col("pid").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    at = at.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("pid") == F.col("p")))
    place = F.row_number().over(Window.partitionBy("source", "pid").orderBy("seq")) + F.col("before")
    at = at.withColumn("copies", (whole + (place <= F.col("extra")).cast("long")).cast("int"))
    return rest.unionByName(at.drop("pid", "seq", "s", "p", "before"))


def mix(docs: DataFrame, **names: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 to 3), taken (copies times size)."""
    sizes = measured(docs, **names)
    rows = _copies(sizes, _bounded(sizes))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, every row as often as the mix takes it; of rows that differ in other columns alone, any."""
    sizes = measured(docs, id_col, text_col, source_col)
    named = docs.select(F.struct("*").alias("row"), F.col(f"`{source_col}`").alias("source"), _hash(f"`{id_col}`", f"`{text_col}`").alias("h"))
    rows = _copies(named, _bounded(sizes))
    return rows.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source),
lvl AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio,
         row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST) AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
goal AS (
  SELECT source, source_size,
         least(CAST(3 * source_size AS DOUBLE), (SELECT coalesce(arg_min(level, place), 0.0) FROM lvl WHERE ratio >= level) * weight) AS target
  FROM lvl),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
run AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS left_over,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS here, count(*) OVER (PARTITION BY s.source, h) AS rows_here,
         row_number() OVER (PARTITION BY s.source, h) AS place
  FROM sizes s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source),
stop AS (
  SELECT source, arg_min(h, h) AS bound, arg_min(floor((left_over - (upto - here)) / (CAST(here AS DOUBLE) / rows_here) + 0.5), h) AS extra
  FROM run WHERE left_over > 0 AND upto > left_over GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN left_over <= 0 THEN 0 WHEN stop.bound IS NULL OR h < stop.bound OR (h = stop.bound AND place <= stop.extra) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run LEFT JOIN stop ON run.source IS NOT DISTINCT FROM stop.source
"""
