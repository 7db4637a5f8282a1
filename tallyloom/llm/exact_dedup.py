"""Exact de-duplication over an extendible-hash index on shared files, with DataFrame operations only.

1. One scan writes the entries (id, 64-bit key, digest) to the shared folder; equal keys are merged into one row each.
2. The directory starts with one bucket. While a bucket holds more than ``capacity`` keys it is split by its next bit,
   and the directory doubles with its deepest bucket. Splitting works on a histogram of key prefixes, which is refined by
   further bits for as long as a bucket is overfull; merged keys are distinct, so this ends for every input.
3. The index: every key with its bucket, dealt by ranges of buckets (ranges of the key) and written sorted. A bucket is
   never torn, so each owner task holds whole buckets.
4. Texts of keys that occur more than once go to the owner of their bucket, combined before by task, so that a text that
   makes up a third of all rows arrives as a few rows. The owner compares them byte by byte; different texts of one
   key are chained.
5. Every entry meets the chains. Groups of more than 1 / ``HOT`` of all entries, of which there are fewer than ``HOT``,
   are sent to every task instead of bringing all their entries to one.

Nulls: a null text counts as empty, a null id is below every other id (a group of null ids alone keeps null).
Repeated rows: every row that carries its group's largest id is marked kept; :func:`survivors` returns one of them.
Very long texts are compared whole. An empty table gives an empty result. Other columns are never read by :func:`dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import SMALL_ROWS, free_name, own_names, small, written

#: Keys of a bucket above which the directory splits it.
CAPACITY = 1 << 15
#: Buckets that are sent to every task at most (20 bytes each); a larger directory is joined by shuffle.
BROADCAST_BUCKETS = 1 << 21
#: Bits by which the histogram of prefixes is refined at a time.
STEP = 8
#: Keys of repeated texts that are sent to every task at most (16 bytes each); beyond, the texts are joined by shuffle.
BROADCAST_KEYS = 1 << 20
HOT = 1 << 15


def _key(text: Column, key_bits: int) -> Column:
    key = F.xxhash64(text)
    return key if key_bits == 64 else F.shiftrightunsigned(key, 64 - key_bits)


def _prefix(key: Column, depth: int, key_bits: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, key_bits - depth)


def directory(keys: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    """depth, slot: the buckets, each the keys whose first ``depth`` bits are ``slot``; at most ``capacity`` keys or all bits each."""
    full, buckets, depth = keys.sparkSession.createDataFrame([(0, 0)], "depth int, slot long"), None, 0
    while True:
        deeper = min(key_bits, depth + STEP)
        inside = keys.withColumn("slot", _prefix(F.col("key"), depth, key_bits)).join(small(full), "slot", "left_semi")
        counts = written(inside.groupBy(_prefix(F.col("key"), deeper, key_bits).alias("prefix")).agg(F.count("*").alias("n")), "dedup-prefixes")
        levels = counts.select("n", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"), "prefix")
        levels = levels.withColumn("slot", F.expr(f"shiftrightunsigned(prefix, {deeper} - depth)"))
        nodes = levels.groupBy("depth", "slot").agg(F.sum("n").alias("n"))
        # a node is split if it is overfull; its halves are buckets if they are not, and the deepest ones go on if they are
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("slot").alias("up"), (F.col("n") > capacity).alias("split"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("slot", 1)).join(parent, ["depth", "up"], "left")
        reached = nodes.where((F.col("depth") == depth) | F.col("split"))
        done = written(reached.where((F.col("n") <= capacity) | (F.col("depth") == key_bits)).select("depth", "slot"), "dedup-buckets")
        full = written(reached.where((F.col("n") > capacity) & (F.col("depth") == deeper) & F.lit(deeper < key_bits)).select("depth", "slot"), "dedup-full")
        buckets = done if buckets is None else buckets.unionByName(done)
        if full.isEmpty():
            return buckets
        depth = deeper


def index(keys: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, int]:
    """The written index, ``keys`` with ``bucket`` (a number in the order of keys) in owners' ranges, and the number of owners."""
    buckets = written(directory(keys, capacity, key_bits), "dedup-directory")
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # at most 65 numbers
    first = F.expr(f"shiftleft(slot, {key_bits} - depth)") if key_bits < 64 else F.expr("if(depth = 0, 0L, shiftleft(slot, 64 - depth))")
    slots = small(buckets.select(F.col("depth").alias("d"), F.col("slot").alias("s"), first.alias("bucket")), BROADCAST_BUCKETS)
    # of a key's prefixes exactly one is a bucket
    tried = F.transform(F.array(*[F.lit(d) for d in depths] or [F.lit(0)]), lambda d: F.struct(d.alias("d"), F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("key"), F.lit(key_bits) - d)).alias("s")))
    placed = keys.select("*", F.inline(tried)).join(slots, ["d", "s"]).drop("d", "s")
    owners = min(max(1, buckets.count()), 1 << 14)  # tasks; each takes whole buckets
    return written(placed.repartitionByRange(owners, "bucket").sortWithinPartitions("bucket", "key"), "dedup-index"), owners


def dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    key_bits: int = 64,
    broadcast_keys: int = BROADCAST_KEYS,
    hot: int = HOT,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chain (its text's place in its key's chain).

    ``key_bits`` below 64 shortens the index key, which makes different texts share keys (tests do so).
    """
    rows = own_names(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", _key(F.col("text"), key_bits))
    entries = written(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "dedup-entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    held, owners = index(keys, capacity, key_bits)

    repeated = written(held.where("n > 1").select("bucket", "key"), "dedup-repeated")
    members = rows.join(small(repeated, broadcast_keys), "key")
    few = members.groupBy("bucket", "key", "text", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    owned = few.repartitionByRange(owners, "bucket").groupBy("bucket", "key", "text").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"))
    links = owned.select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")) - 1
    chains = written(links.select("key", "text_sha256", "group_size", "keep_id", place.alias("chain")), "dedup-chains")

    large = chains.where(F.col("group_size") * hot > entries.count())  # fewer than ``hot`` rows
    on = ["key", "text_sha256"]
    crowded = entries.join(F.broadcast(large), on)
    found = entries.join(F.broadcast(large.select(on)), on, "left_anti").join(small(chains, min(broadcast_keys, SMALL_ROWS)), on, "left").unionByName(crowded)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.coalesce("chain", F.lit(0)).alias("chain"),
    )


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, one row for each distinct text: the one with the largest id, an arbitrary one of ties."""
    found = dedup(docs, id_col=id_col, text_col=text_col, **options)
    digest, twin = free_name(docs, "text_sha256"), free_name(docs, "twin_id")
    away = written(
        found.where("group_size > 1").groupBy("text_sha256", "doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "dedup-away"
    )
    dropped = away.where("not kept").select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(twin))
    tied = away.where("kept and n > 1").select(F.col("text_sha256").alias(digest), F.col("doc_id").alias(twin))
    marked = docs.withColumn(digest, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))

    def same(right: DataFrame) -> Column:
        return (marked[digest] == right[digest]) & marked[id_col].eqNullSafe(right[twin])

    dropped = written(dropped, "dedup-dropped")
    few = small(dropped)
    rest = marked.join(few, same(few), "left_anti")
    if tied.isEmpty():
        return rest.drop(digest)
    marked = rest
    once = rest.join(tied, same(tied), "left_semi").dropDuplicates([digest, id_col])
    return rest.join(tied, same(tied), "left_anti").unionByName(once).drop(digest)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256,
       CAST(0 AS INTEGER) AS chain
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
