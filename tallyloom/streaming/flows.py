"""Structured Streaming counterparts: daily windows, exactly-once intake, sessions of activity, open items, late counterparts, anchors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.store import shared_folder

#: Groups of accounts in a state that is kept by Python.
BUCKETS = 1 << 13
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """The events of a folder as a stream, with an event time."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums in tumbling days; events later than ``late`` are left out once their day is closed."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def activity(stream: DataFrame, gap: str = "6 hours", late: str | None = "1 day") -> DataFrame:
    """Sessions of a user: runs of events without a pause of ``gap``. Without ``late`` no event is late and no session closes."""
    return (stream.withWatermark("at", late) if late else stream).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """The first row of each key; with ``late`` the state of older keys is forgotten."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])


def item_state(stream: DataFrame) -> DataFrame:
    """stream: account_id, kind ("open" or "clear"), amount. Each account's open items, as they change: a built-in aggregate.

    The state is a row per account; it never expires, as an account's items do not.
    """
    opened = F.col("kind") == "open"
    return stream.groupBy("account_id").agg(
        F.sum(F.when(opened, 1).otherwise(-1)).alias("open_items"), F.round(F.sum(F.when(opened, F.col("amount")).otherwise(-F.col("amount"))), 2).alias("open_amount"), F.count_if(~opened).alias("cleared_items")
    )


def counterparts(stream: DataFrame) -> DataFrame:
    """stream: account_id, ref, side ("statement" or "ledger"), amount, at. Each reference's item, as it changes.

    An item is open from its first row on, and is cleared when its other side comes, however late, with an amount within a
    cent. The state is a row per account and reference.
    """
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("amount")))
    rows = stream.groupBy("account_id", "ref").agg(F.min("at").alias("opened_at"), F.max("at").alias("last_at"), total("statement").alias("s"), total("ledger").alias("l"))
    cleared = F.coalesce(F.abs(F.col("s") - F.col("l")) < 0.01, F.lit(False))
    return rows.select("account_id", "ref", "opened_at", F.when(cleared, "cleared").otherwise("open").alias("status"), F.when(cleared, F.col("last_at")).alias("cleared_at"))


def anchor_state(stream: DataFrame, tolerance: float = 0.01, buckets: int = BUCKETS) -> DataFrame:
    """stream: account_id, seq, opening, closing. Every file as it comes, with the anchor it met and whether it was accepted.

    The state of an account is the closing of its last accepted file; a refused file leaves it. Files of one batch are taken in
    order of ``seq``, batches in the order of their arrival. Accounts are dealt by hash into ``buckets`` groups, whose accounts
    are taken through a batch together, as a group costs some milliseconds whatever is in it. The state of a group is a list of
    its accounts' anchors.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchors = dict(zip(*state.get)) if state.exists else {}
        files = pd.concat([p for p in parts if len(p)]).sort_values("seq", kind="stable")
        met, accepted = [], []
        for account, opening, closing in zip(files["account"].tolist(), files["opening"].tolist(), files["closing"].tolist()):
            anchor = anchors.get(account)
            fits = anchor is None or abs(round(opening - anchor, 4)) <= tolerance
            met.append(anchor)
            accepted.append(fits)
            if fits:
                anchors[account] = closing
        state.update((list(anchors), list(anchors.values())))
        yield pd.DataFrame({"account": files["account"], "seq": files["seq"], "anchor": pd.Series(met, files.index, float), "accepted": accepted})

    kind = stream.schema["account_id"].dataType
    rows = stream.select(F.pmod(F.xxhash64("account_id"), F.lit(buckets)).alias("bucket"), F.col("account_id").cast("string").alias("account"), "seq", "opening", "closing")
    out = rows.groupBy("bucket").applyInPandasWithState(fold, "account string, seq timestamp_ntz, anchor double, accepted boolean", "accounts array<string>, anchors array<double>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("account").cast(kind).alias("account_id"), "seq", "anchor", "accepted")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str, *, merge: Callable[[DataFrame], DataFrame] | None = None, into: str | None = None, timers: bool = False) -> DataFrame:
    """All that is there now, through a checkpointed query, as a table.

    Batches are written with their number; ``merge`` gets them all (column ``_batch``) and keeps what counts. A folder ``into``
    that an earlier call has filled is gone on with from its checkpoint. ``timers``: the query has state of its own and timers,
    which one of Spark's two stores of state offers.
    """
    spark = stream.sparkSession
    base = into or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/_batch=-1")  # where no file is, there is no batch

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/_batch={number}")  # a batch that is run again replaces itself

    before = spark.conf.get(_PROVIDER)
    if timers:
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    got = spark.read.schema(stream.schema.add("_batch", "long")).option("basePath", f"{base}/out").parquet(f"{base}/out")
    return (merge(got) if merge else got).drop("_batch")


def last_batch(df: DataFrame) -> DataFrame:
    """Complete mode: every batch holds the whole result."""
    last = df.agg(F.max("_batch").alias("_last"))
    return df.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_last")  # one row


def latest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Update mode: of each key the row of its last batch."""

    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "_batch").alias("r")).select("r.*")

    return merge


def take_in(files: DataFrame, into: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A folder watched for files (stream of path, content): each content is parsed and stored once."""

    def put(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{into}/_batch={number}")

    fresh = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
