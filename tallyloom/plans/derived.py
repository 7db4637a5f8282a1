"""The driver's tables as reconciliation tables, in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
SESSIONS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def _ref(key: Column) -> Column:
    return F.concat(F.lit("REF"), F.lpad(key.cast("string"), 9, "0"))


def stmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.where(k % 20 != 18).select(
        (k % SESSIONS).alias("session_id"),
        k.alias("row_number"),
        _day(F.col("o_orderdate")).alias("value_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "D").otherwise("C").alias("sign"),
        _ref(k).alias("our_ref"),
        F.lit("").alias("their_ref"),
        F.concat(F.lit("payment "), F.col("o_orderpriority")).alias("booking_text_1"),
        F.lit("").alias("booking_text_2"),
    )


def ledg(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    b = k % 20
    return o.where(b != 19).select(
        (k % SESSIONS).alias("session_id"),
        k.alias("row_number"),
        F.when(b.isin(14, 15, 16, 17), "").otherwise(_ref(k)).alias("trn_ref"),
        _day(F.when(b.isin(16, 17), F.date_add(F.col("o_orderdate").cast("date"), 1)).otherwise(F.col("o_orderdate").cast("date"))).alias("value_date"),
        F.when(F.col("o_orderstatus") == "F", "CR").otherwise("DR").alias("type"),
        F.concat(F.lit("posting "), F.col("o_orderpriority")).alias("narration"),
        F.when(b.isin(11, 12, 13), F.col("o_totalprice") - 15 - k % 40).otherwise(F.col("o_totalprice")).alias("amount"),
        F.lit("USD").alias("ccy"),
        F.lit("").alias("external_ref"),
        F.concat(F.lit("MOD"), k % 3).alias("module"),
        F.concat(F.lit("user"), k % 7).alias("user_id"),
        F.concat(F.lit("BR"), k % 5).alias("ac_branch"),
    )


STMT = f"""stmt AS (
  SELECT o_orderkey % {SESSIONS} AS session_id, o_orderkey AS row_number, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date,
         o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'C' END AS sign,
         'REF' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS our_ref, 'payment ' || o_orderpriority AS booking_text_1
  FROM orders WHERE o_orderkey % 20 <> 18)"""
LEDG = f"""ledg AS (
  SELECT o_orderkey % {SESSIONS} AS session_id, o_orderkey AS row_number,
         CASE WHEN o_orderkey % 20 IN (14, 15, 16, 17) THEN '' ELSE 'REF' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS trn_ref,
         CAST(strftime(CASE WHEN o_orderkey % 20 IN (16, 17) THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y%m%d') AS INTEGER) AS value_date,
         CASE WHEN o_orderstatus = 'F' THEN 'CR' ELSE 'DR' END AS type, 'posting ' || o_orderpriority AS narration,
         CASE WHEN o_orderkey % 20 IN (11, 12, 13) THEN o_totalprice - 15 - o_orderkey % 40 ELSE o_totalprice END AS amount,
         'USD' AS ccy, 'MOD' || (o_orderkey % 3) AS module, 'user' || (o_orderkey % 7) AS user_id, 'BR' || (o_orderkey % 5) AS ac_branch
  FROM orders WHERE o_orderkey % 20 <> 19)"""
PAIRS = STMT + "," + LEDG + """,
pairs AS (
  SELECT l.session_id, l.row_number AS l_row, r.row_number AS r_row, l.our_ref AS ref, r.amount - l.amount AS amount_diff,
         abs(r.amount - l.amount) <= 0.01 AS amount_ok, r.trn_ref <> '' AND l.our_ref = r.trn_ref AS ref_ok, l.value_date = r.value_date AS same_day,
         abs(date_diff('day', strptime(CAST(l.value_date AS VARCHAR), '%Y%m%d'), strptime(CAST(r.value_date AS VARCHAR), '%Y%m%d'))) <= 1 AS next_day
  FROM stmt l JOIN ledg r ON l.session_id = r.session_id AND r.type = CASE l.sign WHEN 'C' THEN 'DR' ELSE 'CR' END
   AND ((r.trn_ref <> '' AND l.our_ref = r.trn_ref) OR r.amount BETWEEN l.amount - 0.02 AND l.amount + 0.02)),
cand AS (
  SELECT session_id, l_row, r_row, CASE WHEN amount_ok AND ref_ok THEN 1 WHEN ref_ok THEN 2 WHEN amount_ok AND same_day THEN 3 WHEN amount_ok AND next_day THEN 4 END AS tier,
         amount_diff, ref FROM pairs)"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assignments with a review status: a function of the order key, so that reports have something to count."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    b = k % 20
    return o.where(b < 18).select(
        (k % SESSIONS).alias("session_id"),
        k.alias("l_row"),
        k.alias("r_row"),
        F.when(b <= 10, 1).when(b <= 13, 2).when(b <= 15, 3).otherwise(4).alias("tier"),
        F.when(b.isin(11, 12, 13), -15.0 - k % 40).otherwise(0.0).alias("amount_diff"),
        F.when(k % 7 < 4, "confirmed").when(k % 7 == 4, "rejected").otherwise("pending").alias("status"),
        F.when(k % 11 == 0, "split").when(k % 5 == 0, "manual").otherwise("engine").alias("source"),
        F.when(k % 3 == 0, F.concat(F.lit("user"), k % 4)).alias("assignee"),
        F.when(k % 9 == 0, "urgent").when(k % 9 == 1, "high").otherwise("normal").alias("priority"),
        F.when(k % 7 < 5, F.timestamp_add("HOUR", (k % 720).cast("int"), F.lit("2024-01-02 00:00:00").cast("timestamp"))).alias("decided_at"),
        F.when(k % 7 < 5, F.concat(F.lit("user"), k % 6)).alias("decided_by"),
        F.date_add(F.lit("2024-01-20").cast("date"), (k % 25).cast("int")).alias("due_date"),
        F.col("o_totalprice").alias("amount"),
    )


ASSIGN = f"""assign AS (
  SELECT o_orderkey % {SESSIONS} AS session_id, o_orderkey AS l_row, o_orderkey AS r_row,
         CASE WHEN o_orderkey % 20 <= 10 THEN 1 WHEN o_orderkey % 20 <= 13 THEN 2 WHEN o_orderkey % 20 <= 15 THEN 3 ELSE 4 END AS tier,
         CASE WHEN o_orderkey % 20 IN (11, 12, 13) THEN -15.0 - o_orderkey % 40 ELSE 0.0 END AS amount_diff,
         CASE WHEN o_orderkey % 7 < 4 THEN 'confirmed' WHEN o_orderkey % 7 = 4 THEN 'rejected' ELSE 'pending' END AS status,
         CASE WHEN o_orderkey % 11 = 0 THEN 'split' WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'engine' END AS source,
         CASE WHEN o_orderkey % 3 = 0 THEN 'user' || (o_orderkey % 4) END AS assignee,
         CASE WHEN o_orderkey % 9 = 0 THEN 'urgent' WHEN o_orderkey % 9 = 1 THEN 'high' ELSE 'normal' END AS priority,
         CASE WHEN o_orderkey % 7 < 5 THEN TIMESTAMP '2024-01-02 00:00:00' + to_hours(CAST(o_orderkey % 720 AS INTEGER)) END AS decided_at,
         CASE WHEN o_orderkey % 7 < 5 THEN 'user' || (o_orderkey % 6) END AS decided_by,
         DATE '2024-01-20' + CAST(o_orderkey % 25 AS INTEGER) AS due_date, o_totalprice AS amount
  FROM orders WHERE o_orderkey % 20 < 18)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and settled items from ``events``: opened in January 2024, seen from the first of February."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("item_id"),
        F.col("user_id").alias("account_id"),
        F.when(i % 2 == 0, "statement").otherwise("ledger").alias("side"),
        (i % 12).alias("session_id"),
        F.col("ts").alias("opened_at"),
        F.col("value").alias("amount"),
        F.when(i % 3 == 0, F.when(i % 2 == 0, "D").otherwise("DR")).otherwise(F.when(i % 2 == 0, "C").otherwise("CR")).alias("sign"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("team"), i % 5).alias("functional_group"),
        F.when(i % 4 == 0, "cleared").when(i % 25 == 1, "written_off").otherwise("open").alias("status"),
        F.when(i % 6 == 0, "USD").when(i % 6 == 1, "EUR").otherwise("LCY").alias("ccy"),
        F.concat(F.lit("note "), F.col("event_type"), F.lit(" "), F.col("props")).alias("narration"),
        F.concat(F.lit("R"), F.lpad(i.cast("string"), 8, "0")).alias("ref"),
        F.when(i % 10 == 3, F.timestamp_add("DAY", F.lit(40), F.col("ts"))).alias("snoozed_until"),
        F.when(i % 8 == 5, F.timestamp_add("DAY", F.lit(2), F.col("ts"))).alias("acknowledged_at"),
        F.when(i % 4 == 0, F.timestamp_add("DAY", (i % 9).cast("int"), F.col("ts"))).alias("cleared_at"),
    )


ITEMS = """items AS (
  SELECT event_id AS item_id, user_id AS account_id, CASE WHEN event_id % 2 = 0 THEN 'statement' ELSE 'ledger' END AS side, event_id % 12 AS session_id,
         ts AS opened_at, value AS amount,
         CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'DR' END ELSE CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'CR' END END AS sign,
         event_type AS category, 'team' || (event_id % 5) AS functional_group,
         CASE WHEN event_id % 4 = 0 THEN 'cleared' WHEN event_id % 25 = 1 THEN 'written_off' ELSE 'open' END AS status,
         CASE WHEN event_id % 6 = 0 THEN 'USD' WHEN event_id % 6 = 1 THEN 'EUR' ELSE 'LCY' END AS ccy,
         'note ' || event_type || ' ' || props AS narration, 'R' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS ref,
         CASE WHEN event_id % 10 = 3 THEN ts + to_days(40) END AS snoozed_until, CASE WHEN event_id % 8 = 5 THEN ts + to_days(2) END AS acknowledged_at,
         CASE WHEN event_id % 4 = 0 THEN ts + to_days(CAST(event_id % 9 AS INTEGER)) END AS cleared_at
  FROM events)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return rows.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("access_area"), F.col("n_name").alias("country"), F.col("c_acctbal").alias("closing"))


ACCOUNTS = """accounts AS (
  SELECT c_custkey AS account_id, c_name AS label, c_mktsegment AS access_area, n_name AS country, c_acctbal AS closing
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per account and month of orders: created at its first day, with balances that chain but for every 13th."""
    o = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = o.groupBy(F.col("o_custkey").alias("account_id"), month.alias("created_at")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents)).alias("net"), F.count("*").alias("rows"), F.min("o_orderkey").alias("session_id"))
    return rows


SESSIONS_SQL = """sess AS (
  SELECT o_custkey AS account_id, date_trunc('month', o_orderdate) AS created_at,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -CAST(round(o_totalprice * 100) AS BIGINT) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS net,
         count(*) AS rows, min(o_orderkey) AS session_id FROM orders GROUP BY 1, 2)"""


def card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages of each order: authorised, cleared with a fee on every tenth, settled but for every seventh."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stages = F.array(
        F.struct(F.lit("auth").alias("stage"), F.lit(1).cast("long").alias("file_id"), F.col("o_totalprice").alias("amount")),
        F.struct(F.lit("clearing").alias("stage"), F.lit(2).cast("long").alias("file_id"), F.when(k % 10 == 0, F.col("o_totalprice") + 1.5).otherwise(F.col("o_totalprice")).alias("amount")),
        F.when(k % 7 != 0, F.struct(F.lit("settlement").alias("stage"), F.lit(3).cast("long").alias("file_id"), F.col("o_totalprice").alias("amount"))),
    )
    rows = o.select(F.concat(F.lit("S"), F.lpad(k.cast("string"), 10, "0")).alias("scheme_ref"), k.alias("k"), F.explode(F.filter(stages, lambda s: s.isNotNull())).alias("s"))
    return rows.where("k % 23 <> 5 or s.stage = 'auth'").select("scheme_ref", "k", "s.stage", "s.file_id", "s.amount", F.lit("USD").alias("ccy"), F.when(F.col("k") % 31 == 0, "disputed").otherwise("new").alias("recon_status"))


CARDS = """cards AS (
  SELECT 'S' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS scheme_ref, o_orderkey AS k, stage, file_id,
         CASE WHEN stage = 'clearing' AND o_orderkey % 10 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END AS amount, 'USD' AS ccy,
         CASE WHEN o_orderkey % 31 = 0 THEN 'disputed' ELSE 'new' END AS recon_status
  FROM orders, (VALUES ('auth', 1), ('clearing', 2), ('settlement', 3)) v(stage, file_id)
  WHERE (stage <> 'settlement' OR o_orderkey % 7 <> 0) AND (o_orderkey % 23 <> 5 OR stage = 'auth'))"""
