"""Queries that run a stream over what is there and return its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import ledgers
from tallyloom.streaming import flows, late

Q, O = {}, {}


def stream_tumbling_daily(spark, d):
    rows = flows.daily(flows.events(spark, d)).select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))
    return flows.drained(rows, "complete", merge=flows.last_batch)


def stream_dedupe(spark, d):
    kept = flows.once(flows.events(spark, d).withColumn("key", F.concat_ws("-", "user_id", "event_type")), "key")
    return flows.drained(kept.select("key"), "append")


def stream_session_window(spark, d):
    """All sessions of what is there, in whatever order files come; open ones too, so the state keeps every session."""
    rows = flows.activity(flows.events(spark, d), late=None).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    return flows.drained(rows, "complete", merge=flows.last_batch)


def stream_open_item_state(spark, d):
    kind = F.when(F.col("event_id") % 4 == 0, "clear").otherwise("open")
    rows = flows.events(spark, d).select(F.col("user_id").alias("account_id"), kind.alias("kind"), F.col("value").alias("amount"))
    return flows.drained(flows.item_state(rows), "update", merge=flows.latest("account_id"))


def stream_counterparts(spark, d):
    """Every second event is the ledger's side of an item whose statement side is another event of the same user, however late."""
    i = F.col("event_id")
    rows = flows.events(spark, d).select(F.col("user_id").alias("account_id"), F.concat(F.lit("R"), F.floor(i / 4).cast("string")).alias("ref"), F.when(i % 2 == 0, "ledger").otherwise("statement").alias("side"), (F.floor(i / 8) * 1.0).alias("amount"), F.col("ts").alias("at"))
    return flows.drained(flows.counterparts(rows), "update", merge=flows.latest("account_id", "ref"))


def _waiting(rows):
    """Events as items of repeated references: five classes of amounts, a cent apart at most within one; every 13th is snoozed."""
    i, at = F.col("event_id"), F.col("at")
    item = rows.select(F.col("user_id").alias("account_id"), F.concat(F.lit("R"), i % 3).alias("ref"), F.lit("item").alias("kind"), i.alias("item_id"), F.when(i % 7 < 3, "ledger").otherwise("statement").alias("side"), (i % 5 + i % 2 * 0.004).alias("amount"), at, F.lit(None).cast("timestamp").alias("until"))
    snooze = rows.where("event_id % 13 = 0").withColumn("until", at + F.expr("INTERVAL 12 days"))
    return item.unionByName(snooze.select(F.col("user_id").alias("account_id"), F.concat(F.lit("R"), i % 3).alias("ref"), F.lit("snooze").alias("kind"), i.alias("item_id"), F.lit("").alias("side"), F.lit(0.0).alias("amount"), at, "until"))


def stream_late_counterparts(spark, d):
    got = flows.drained(late.late_counterparts(_waiting(flows.events(spark, d))), "update", merge=flows.latest("item_id"), timers=True)
    return got.select("item_id", "status", "other_id")


def stream_anchors(spark, d):
    """The files of every account in two folders, each taken in once it is there; the chain's state goes on from the first to the second."""
    import uuid

    from tallyloom.operators.store import shared_folder, written
    from tallyloom.plans.ledgers import _chain

    base = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    chain = written(_chain(spark, d).select("account_id", "seq", "opening", "closing"), "chain")
    for at, part in enumerate((F.col("seq") < "1995-01-01", F.col("seq") >= "1995-01-01")):
        chain.where(part).write.parquet(f"{base}/in/{at}")
        stream = spark.readStream.schema(chain.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        got = flows.drained(flows.anchor_state(stream), "append", into=f"{base}/run")
    return got


Q |= {f.__name__: f for f in (stream_tumbling_daily, stream_dedupe, stream_session_window, stream_open_item_state, stream_counterparts, stream_late_counterparts, stream_anchors)}
O |= {
    "stream_tumbling_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_dedupe": "SELECT DISTINCT user_id || '-' || event_type AS key FROM events",
    "stream_session_window": """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_s FROM e)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS n FROM s GROUP BY user_id, n_s""",
    "stream_counterparts": """WITH e AS (SELECT user_id AS account_id, 'R' || (event_id // 4) AS ref, ts, CASE WHEN event_id % 2 = 0 THEN event_id // 8 END AS l, CASE WHEN event_id % 2 = 1 THEN event_id // 8 END AS s FROM events),
g AS (SELECT account_id, ref, min(ts) AS opened_at, max(ts) AS last_at, sum(l) AS l, sum(s) AS s FROM e GROUP BY 1, 2)
SELECT account_id, ref, opened_at, CASE WHEN abs(l - s) < 0.01 THEN 'cleared' ELSE 'open' END AS status, CASE WHEN abs(l - s) < 0.01 THEN last_at END AS cleared_at FROM g""",
    "stream_late_counterparts": """WITH i AS (SELECT user_id, event_id % 3 AS ref, event_id, event_id % 5 AS class, event_id % 7 < 3 AS booked, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref, class, booked ORDER BY ts, event_id) AS n FROM i)
SELECT a.event_id AS item_id, CASE WHEN b.event_id IS NOT NULL THEN 'cleared' WHEN a.ts + CASE WHEN a.event_id % 13 = 0 THEN INTERVAL 12 DAY ELSE INTERVAL 7 DAY END <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) THEN 'escalated' ELSE 'open' END AS status, b.event_id AS other_id
FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.ref = b.ref AND a.class = b.class AND a.n = b.n AND a.booked <> b.booked""",
    "stream_anchors": ledgers.O["continuity_chain"].replace("SELECT account_id, seq, anchor, gap, accepted FROM fold", "SELECT account_id, seq, anchor, accepted FROM fold"),
    "stream_open_item_state": """SELECT user_id AS account_id, count(*) FILTER (WHERE event_id % 4 <> 0) - count(*) FILTER (WHERE event_id % 4 = 0) AS open_items,
 round(sum(CASE WHEN event_id % 4 = 0 THEN -value ELSE value END), 2) AS open_amount, count(*) FILTER (WHERE event_id % 4 = 0) AS cleared_items FROM events GROUP BY 1""",
}
