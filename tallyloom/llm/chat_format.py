"""Chat formatting by perspective rotation, with DataFrame operations only.

For every participant of a dialogue the whole dialogue is rendered once: that speaker's turns as the assistant's, the
others' as named users', system turns as they are. ``mask`` lists the spans (code points, end exclusive) of the
rendered text on which a model is trained: the content and the end mark of the chosen speaker's turns.

A dialogue of more than ``max_turns`` turns is rendered in consecutive parts of so many, so that no row grows without
bound. Its participants are those of the whole dialogue, so each gets every part, and ``start`` is where the part begins in
that speaker's whole rendering: the parts joined are the dialogue. Their turns are numbered by range partitions and the
counts of these, not in one task.

Nulls: a null role speaks as "unknown", a null text is empty, null conversation ids form one dialogue, a null turn
comes first. Ties in the turn number are ordered by role, then text; repeated rows are rendered as often as they occur.
A very long text stays whole in its turn. A dialogue of system turns alone has no participant and so no row. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import own_names, small, written

START, END = "<|im_start|>", "<|im_end|>\n"
MAX_TURNS = 1024


def _numbered(rows: DataFrame) -> DataFrame:
    """conv_id, t, place (from 0) in the order of turns. A dialogue may be spread over all partitions of the sort."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal turns may part
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    laid = salted.repartitionByRange(parts, "conv_id", "t", "salt").sortWithinPartitions("conv_id", "t", "salt")
    laid = written(laid.select("conv_id", "t", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")), "chat-sorted")
    ranges = laid.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), (before - F.col("first")).alias("shift"))
    rows = laid.join(ranges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")))
    return rows.select("conv_id", "t", (F.col("at") + F.col("shift")).alias("place"))


def _rendered(each: DataFrame) -> DataFrame:
    """each: conv_id, part, ts (the part's turns in order), speaker."""

    def head(t):
        return F.concat(
            F.lit(START),
            F.when(t["role"] == "system", "system").when(t["role"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), t["role"])),
            F.lit("\n"),
        )

    parts = F.transform("ts", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    each = each.select("conv_id", "part", "speaker", parts.alias("ps"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done, p):
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return each.select(
        "conv_id",
        "part",
        "speaker",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("ps", start, step)["spans"], ",").alias("mask"),
        F.size("ps").cast("long").alias("n_turns"),
        F.size(F.filter("ps", lambda p: p["own"])).cast("long").alias("n_trained"),
    )


def rotate(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_turns: int = MAX_TURNS,
) -> DataFrame:
    """conv_id, part, speaker, rendered, mask, n_turns, n_trained, start."""
    rows = own_names(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = written(sizes.where(F.col("n") > max_turns).select(F.col("conv_id").alias("c")), "chat-long")
    any_long = not long.isEmpty()
    of_long = F.col("conv_id").eqNullSafe(F.col("c"))

    short = rows.join(small(long), of_long, "left_anti") if any_long else rows
    talks = short.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # at most max_turns
    people = F.array_distinct(F.filter(F.transform("ts", lambda t: t["role"]), lambda r: r != "system"))
    out = _rendered(talks.select("conv_id", F.lit(0).cast("long").alias("part"), "ts", F.explode(people).alias("speaker"))).withColumn("start", F.lit(0).cast("long"))
    if not any_long:
        return out

    wide = rows.join(small(long), of_long, "left_semi")
    who = wide.where("t.role <> 'system'").select(F.col("conv_id").alias("c"), F.col("t.role").alias("speaker")).distinct()
    parts = _numbered(wide).groupBy("conv_id", F.expr(f"place div {max_turns}").alias("part")).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    each = _rendered(parts.join(who, of_long).select("conv_id", "part", "ts", "speaker"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return out.unionByName(each.withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long"))))


ORACLE = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM r),
t AS (SELECT *, place // {MAX_TURNS} AS part FROM n),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
seg AS (
  SELECT t.*, speaker, role = speaker AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
pos AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM seg),
p AS (
  SELECT conv_id, part, speaker, string_agg(head || body, '' ORDER BY place) AS rendered,
         coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR) END, ',' ORDER BY place), '') AS mask,
         count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained
  FROM pos GROUP BY conv_id, part, speaker)
SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM p
"""
