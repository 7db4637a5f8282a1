"""Queries over sources and sinks: files are made of the driver's tables, read back and compared with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import amounts, dates, narration, pan, text
from tallyloom.operators.store import shared_folder, written
from tallyloom.plans import derived as D
from tallyloom.sinks import tables
from tallyloom.sources import camt, csv_profile, files, mt, xlsx

Q, O = {}, {}
#: Lines that a task sorts and writes of a file that is written in parts.
LINES = 1_000_000


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return add


def _joined(rows: DataFrame, key: str, order: str, line, between: str = "") -> DataFrame:
    """key, body: the lines of each key in order. A key's rows are one file."""
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("ls"))
    return lines.select(key, F.array_join(F.transform("ls", lambda x: x["line"]), between).alias("body"))


def _comma(a):
    return F.translate(F.format_string("%.2f", a), ".", ",")


# -- statements ----------------------------------------------------------------------------------------------------


def _mt_files(spark, d) -> DataFrame:
    """A message per customer; every seventh line is broken, every eleventh customer's balances have no decimal comma; two messages to a file."""
    o = D.table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyMMdd")
    mark = F.when(k % 9 == 0, F.lit("RC")).when(F.col("o_orderstatus") == "F", F.lit("D")).otherwise("C")
    line = F.concat(
        F.lit(":61:"), F.when(k % 7 == 0, F.lit("")).otherwise(day), F.when(k % 2 == 0, F.date_format("o_orderdate", "MMdd")).otherwise(""), mark, F.when(k % 3 == 0, F.lit("K")).otherwise(""),
        _comma(F.col("o_totalprice")), F.lit("NTRFREF"), k, F.when(k % 4 == 0, F.concat(F.lit("//BANK"), k)).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("\nsupplement "), k)).otherwise(""),
        F.lit("\n:86:paid "), F.col("o_orderpriority"), F.lit("\nin full\n"),
    )
    body = _joined(o, "o_custkey", "o_orderkey", line).withColumn("c", F.col("o_custkey"))
    c = F.col("c")
    amount = F.when(c % 11 == 0, F.concat(c.cast("string"))).otherwise(F.concat(c.cast("string"), F.lit(",5")))
    message = F.concat(F.lit("{1:F01AAAABBCCAXXX0000000000}{2:I"), F.when(c % 13 == 0, "941").otherwise("940"), F.lit("BANKGB2LXXXXN}{4:\n:20:S"), c, F.lit("\n:25:ACC"), c, F.lit("\n:28C:"), c, F.lit("/1\n:60F:C240101USD"), amount, F.lit("\n"), "body", F.lit(":62F:D240131USD"), amount, F.lit("\n-}\n"))
    return body.groupBy(F.floor(c / 2).alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", message.alias("m")))), lambda x: x["m"]), "").alias("text")).select(F.concat(F.lit("f"), "f").alias("path"), "text")


_MT_FROM = """m AS (SELECT DISTINCT o_custkey AS c FROM orders), p AS (SELECT c, 'f' || (c // 2) || CASE WHEN row_number() OVER (PARTITION BY c // 2 ORDER BY c) = 2 THEN '#2' ELSE '' END AS path FROM m),
f AS (SELECT * FROM p WHERE c % 13 <> 0)"""


@query("WITH " + _MT_FROM + """, l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders)
SELECT path, row_number, CAST('20' || strftime(o_orderdate, '%y%m%d') AS INTEGER) AS value_date, CAST('20' || strftime(o_orderdate, '%y%m%d') AS INTEGER) AS book_date, round(o_totalprice, 2) AS amount,
 CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN 'D' ELSE 'C' END AS sign, o_orderkey % 9 = 0 AS reversed, 'REF' || o_orderkey AS our_ref, CASE WHEN o_orderkey % 4 = 0 THEN 'BANK' || o_orderkey ELSE '' END AS their_ref,
 CASE WHEN o_orderkey % 5 = 0 THEN 'supplement ' || o_orderkey ELSE '' END AS booking_text_1, 'paid ' || trim(o_orderpriority) || ' in full' AS booking_text_2 FROM f JOIN l ON o_custkey = c WHERE o_orderkey % 7 <> 0""")
def source_mt_lines(spark, d):
    rows = mt.lines(mt.messages(_mt_files(spark, d)))
    return rows.select("path", "row_number", "value_date", "book_date", "amount", "sign", "reversed", "our_ref", "their_ref", "booking_text_1", "booking_text_2")


@query("WITH " + _MT_FROM + """ SELECT path, 'ACC' || c AS account, 'S' || c AS statement_ref, 'USD' AS currency, CASE WHEN c % 11 = 0 THEN c ELSE c + 0.5 END::DOUBLE AS opening, CASE WHEN c % 11 = 0 THEN c ELSE c + 0.5 END::DOUBLE AS closing, 'BANKGB2L' AS bic FROM f""")
def source_mt_balances(spark, d):
    rows = mt.statements(mt.messages(_mt_files(spark, d)))
    return rows.select("path", "account", "statement_ref", "currency", F.col("opening.amount").alias("opening"), F.col("closing.amount").alias("closing"), "bic")


@query("WITH " + _MT_FROM + """, t AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN 0 ELSE round(o_totalprice, 2) END) AS cr, sum(CASE WHEN o_orderkey % 9 <> 0 AND o_orderstatus = 'F' THEN round(o_totalprice, 2) ELSE 0 END) AS dr FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
SELECT path, coalesce(n, 0) AS rows, round(coalesce(cr, 0), 2) AS credits, round(coalesce(dr, 0), 2) AS debits FROM f LEFT JOIN t ON o_custkey = c""")
def batch_totals(spark, d):
    m = mt.messages(_mt_files(spark, d))
    return tables.batch_totals(mt.lines(m), mt.statements(m)).select("path", "rows", "credits", "debits")


def _camt_files(spark, d) -> DataFrame:
    """A file per customer: every tenth is cut off, every tenth but five declares a document type; every eighth entry has no number as its amount."""
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    day = tag("Dt", F.date_format("o_orderdate", "yyyy-MM-dd"))
    entry = tag(
        "Ntry", F.lit('<Amt Ccy="EUR">'), F.when(k % 8 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", "o_totalprice")), F.lit("</Amt>"), tag("CdtDbtInd", F.when(F.col("o_orderstatus") == "F", "DBIT").otherwise("CRDT")),
        F.when(k % 3 == 0, F.lit("")).otherwise(tag("ValDt", day)), tag("BookgDt", day), tag("AcctSvcrRef", F.concat(F.lit("SVC"), k)),
        tag("NtryDtls", tag("TxDtls", tag("Refs", tag("EndToEndId", F.when(k % 4 == 0, "NOTPROVIDED").otherwise(F.concat(F.lit("E2E"), k))), tag("InstrId", F.concat(F.lit("INS"), k))), tag("RmtInf", tag("Ustrd", "o_orderpriority")))),
    )
    body, c = _joined(o, "o_custkey", "o_orderkey", entry), F.col("o_custkey")
    head = F.concat(F.when(c % 10 == 5, F.lit("<!DOCTYPE x>")).otherwise(""), F.lit('<Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt>'), tag("Id", F.concat(F.lit("ID"), c)), tag("Acct", tag("Id", tag("IBAN", F.concat(F.lit("IB"), c))), tag("Ccy", F.lit("EUR"))))
    balance = tag("Bal", tag("Tp", tag("CdOrPrtry", tag("Cd", F.lit("CLBD")))), F.lit('<Amt Ccy="EUR">'), c.cast("string"), F.lit("</Amt><CdtDbtInd>CRDT</CdtDbtInd>"))
    return body.select(F.concat(F.lit("c"), c).alias("path"), F.concat(head, balance, "body", F.when(c % 10 == 0, F.lit("")).otherwise("</Stmt></BkToCstmrStmt></Document>")).alias("text"))


@query("""SELECT 'c' || o_custkey AS path, row_number, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date, round(o_totalprice, 2) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'C' END AS sign,
 CASE WHEN o_orderkey % 4 = 0 THEN 'INS' ELSE 'E2E' END || o_orderkey AS our_ref, 'SVC' || o_orderkey AS their_ref, o_orderpriority AS booking_text_1
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders) WHERE o_custkey % 10 NOT IN (0, 5) AND o_orderkey % 8 <> 0""")
def source_camt_entries(spark, d):
    return camt.entries(_camt_files(spark, d)).select("path", "row_number", "value_date", "amount", "sign", "our_ref", "their_ref", "booking_text_1")


@query("""SELECT DISTINCT 'c' || o_custkey AS path, CASE WHEN o_custkey % 10 NOT IN (0, 5) THEN 'IB' || o_custkey END AS account, CASE WHEN o_custkey % 10 NOT IN (0, 5) THEN o_custkey::DOUBLE END AS closing,
 CASE o_custkey % 10 WHEN 0 THEN 'not well-formed' WHEN 5 THEN 'document type declared' END AS error FROM orders""")
def source_camt_files(spark, d):
    """Every file with its account and closing balance, or with the error that kept it out."""
    return camt.statements(_camt_files(spark, d)).select("path", "account", F.col("closing.amount").alias("closing"), "error")


# -- delimited files and workbooks -------------------------------------------------------------------------------------


def _csv_files(spark, d) -> DataFrame:
    """A file per 25th of the customers: quoted notes with delimiters and line breaks, amounts and dates that are none."""
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    amount = F.when(k % 7 == 0, F.element_at(F.array(F.lit("12abc34"), F.lit("12/05/2024"), F.lit("1 USD 5"), F.lit("12-")), (k % 4 + 1).cast("int"))).otherwise(F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.format_string("%.2f", "o_totalprice")))
    note = F.when(k % 5 == 0, F.concat(F.lit('"line one, of "'), F.lit('"'), "o_orderpriority", F.lit('""\nline two"'))).otherwise(F.col("o_orderpriority"))
    day = F.when(k % 11 == 0, F.lit("31/31/2024")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat_ws(",", day, F.concat(F.lit("R"), k), note, amount, F.concat(F.lit("411111******"), F.lpad((k % 10000).cast("string"), 4, "0")))
    body = _joined(o.withColumn("f", F.col("o_custkey") % 25), "f", "o_orderkey", line, "\n")
    return body.select(F.concat(F.lit("f"), "f").alias("path"), F.concat(F.lit("Date,Ref,Memo,Amount,Card\r\n"), "body", F.lit("\n\n")).alias("text"))


_CSV = "SELECT *, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS row_number FROM orders"


@query(f"""SELECT 'f' || (o_custkey % 25) AS path, row_number, 'R' || o_orderkey AS trn_ref, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'DR' ELSE 'CR' END AS type,
 CASE WHEN o_orderkey % 5 = 0 THEN 'line one, of "' || o_orderpriority || '"' || chr(10) || 'line two' ELSE trim(o_orderpriority) END AS narration FROM ({_CSV}) WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def source_csv_rows(spark, d):
    good, _ = csv_profile.load(_csv_files(spark, d), csv_profile.PRESETS["plain"])
    return good.select("path", "row_number", "trn_ref", "value_date", "amount", "type", "narration")


@query(f"""SELECT 'f' || (o_custkey % 25) AS path, row_number, CASE WHEN o_orderkey % 7 = 0 THEN 'amount' ELSE 'date' END AS error FROM ({_CSV}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def source_csv_errors(spark, d):
    return csv_profile.load(_csv_files(spark, d), csv_profile.PRESETS["plain"])[1].select("path", "row_number", "error")


def _trailing(text):
    """The same files with a repeated name, trailing delimiters and blank names, as exports have them."""
    head = F.regexp_replace(text, r"^Date,Ref,Memo,Amount,Card", "Date,Ref,Memo,Amount,Card,Ref,,")
    return F.regexp_replace(head, r"(\*{6}\d{4})", "$1,other,,")


@query(O["source_csv_rows"])
def source_csv_trailing(spark, d):
    f = _csv_files(spark, d).withColumn("text", _trailing(F.col("text")))
    good, _ = csv_profile.load(f, csv_profile.PRESETS["plain"])
    return good.select("path", "row_number", "trn_ref", "value_date", "amount", "type", "narration")


@query("""SELECT 'R' || o_orderkey AS trn_ref, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS row_number, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date, o_totalprice AS amount, trim(o_orderpriority) AS narration FROM orders""")
def source_csv_splits(spark, d):
    """Three files of all orders, each written in parts of some ``LINES`` lines and read line by line in as many splits as they have."""
    o = D.table(spark, d, "orders")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("R"), "o_orderkey"), "o_orderpriority", F.format_string("%.2f", "o_totalprice"))
    head = spark.createDataFrame([(f, -1, "Date,Ref,Memo,Amount") for f in range(3)], "f long, k long, value string")
    rows = head.unionByName(o.select((F.col("o_custkey") % 3).alias("f"), F.col("o_orderkey").alias("k"), line.alias("value")))
    path = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    ranges = max(3, o.count() // LINES + 1)
    rows.repartitionByRange(ranges, "f", "k").sortWithinPartitions("f", "k").select("f", "value").write.partitionBy("f").text(path)
    plain = csv_profile.PRESETS["plain"]
    good, _ = csv_profile.typed(csv_profile.read_lines(spark, path, plain, parts=True), plain)
    return good.select("trn_ref", F.col("row_number").cast("long").alias("row_number"), "value_date", "amount", "narration")


@query("""SELECT 'R' || o_orderkey AS scheme_ref, 'clearing' AS stage, round(o_totalprice, 2) AS amount, '411111' AS pan_first6, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS pan_last4 FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def source_card_csv(spark, d):
    good, _ = csv_profile.load(_csv_files(spark, d), csv_profile.PRESETS["plain"])
    return csv_profile.to_cards(good, "Card", stage="clearing", file_id=7).select("scheme_ref", "stage", "amount", "pan_first6", "pan_last4")


@query("""SELECT 'book' || (o_custkey % 6) AS book, 'T' || o_orderkey AS trn_ref, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date, CASE WHEN o_orderstatus = 'F' THEN 'DR' ELSE 'CR' END AS type, o_totalprice AS amount, o_orderpriority AS narration FROM orders""")
def workbook_roundtrip(spark, d):
    """Ledger rows written as workbooks by the tasks and read back from their parts."""
    o = D.table(spark, d, "orders")
    sheet = o.select(
        F.concat(F.lit("book"), F.col("o_custkey") % 6).alias("tab"), F.concat(F.lit("T"), "o_orderkey").alias("TRN_REF_NO"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("BOOKING_DATE"), F.when(F.col("o_orderstatus") == "F", "DR").otherwise("CR").alias("TYPE"),
        F.col("o_orderpriority").alias("TXN_NARRATIONS"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("VALUE_DATE"), F.col("o_totalprice").alias("LCY_AMOUNT"),
    )
    books = tables.workbooks(sheet, "tab", 2000).select(F.concat_ws("-", "tab", "part").alias("path"), "content")
    return xlsx.ledger(xlsx.rows(books)).select(F.split_part("path", F.lit("-"), F.lit(1)).alias("book"), "trn_ref", "value_date", "type", "amount", "narration")


@query("WITH " + D.ITEMS + " SELECT CASE WHEN ccy <> 'LCY' THEN ccy ELSE functional_group END AS tab, item_id, round(amount, 2) AS amount FROM items WHERE status = 'open'")
def sink_tabs(spark, d):
    """A report with a folder per tab, written and read back."""
    i = D.items(spark, d).where("status = 'open'")
    path = f"{shared_folder(spark)}/tabs-{uuid.uuid4().hex}"
    tables.write_tabs(i.select(F.when(F.col("ccy") != "LCY", F.col("ccy")).otherwise(F.col("functional_group")).alias("tab"), "item_id", "amount"), "tab", path)
    back = spark.read.schema("item_id long, amount double, tab string").option("header", True).csv(path)
    return back.select("tab", "item_id", F.round("amount", 2).alias("amount"))


@query("WITH " + D.ASSIGN + " SELECT session_id, l_row, tier, status FROM assign")
def sink_sessions(spark, d):
    """Assignments appended session by session, twice half of them, and read back."""
    a = D.assignments(spark, d).select("session_id", "l_row", "tier", "status")
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    tables.append_sessions(a.where("session_id < 4"), path)
    tables.append_sessions(a.where("session_id >= 4"), path)
    return spark.read.schema("l_row long, tier int, status string, session_id long").parquet(path).select("session_id", "l_row", "tier", "status")


@query("WITH " + D.ITEMS + "," + D.SESSIONS_SQL + """ SELECT 'summary' AS part, account_id, sign AS key, count(*) AS n FROM items WHERE status = 'open' GROUP BY 2, 3 UNION ALL SELECT 'items', account_id, '', count(*) FROM items WHERE status = 'open' GROUP BY 2
UNION ALL SELECT 'continuity', account_id, '', count(*) FROM sess GROUP BY 2""")
def sink_one_sided(spark, d):
    """The book of one-sided accounts, written and counted."""
    from tallyloom.plans.ledgers import _chain

    path = f"{shared_folder(spark)}/book-{uuid.uuid4().hex}"
    tables.one_sided(D.items(spark, d), _chain(spark, d), path)
    part = lambda name, key: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), "account_id", key.alias("key"), *([F.col("items").alias("n")] if name == "summary" else [F.lit(1).cast("long").alias("n")]))
    rows = part("summary", F.col("sign")).unionByName(part("items", F.lit(""))).unionByName(part("continuity", F.lit("")))
    return rows.groupBy("part", "account_id", "key").agg(F.sum("n").alias("n"))


@query("WITH " + D.PAIRS + """, m AS (SELECT * FROM cand WHERE tier IS NOT NULL AND l_row = r_row) SELECT 'summary' AS part, session_id, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'matched', session_id, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'unmatched_statement', session_id, count(*) FROM stmt WHERE row_number NOT IN (SELECT l_row FROM m) GROUP BY 2 UNION ALL SELECT 'unmatched_ledger', session_id, count(*) FROM ledg WHERE row_number NOT IN (SELECT r_row FROM m) GROUP BY 2""")
def sink_two_sided(spark, d):
    """The book of two-sided accounts: a summary, the matched pairs and both sides' rest, written and counted."""
    from tallyloom.operators import resolve

    left, right = D.stmt(spark, d), D.ledg(spark, d)
    matched = written(resolve.assigned(left, right), "book-matched")
    path = f"{shared_folder(spark)}/book-{uuid.uuid4().hex}"
    summary = matched.groupBy("session_id").agg(F.count("*").alias("n"))
    tables.two_sided(summary, matched, resolve.unmatched(left, matched, "l"), resolve.unmatched(right, matched, "r"), path)
    out = spark.read.parquet(f"{path}/summary").select(F.lit("summary").alias("part"), "session_id", "n")
    for name in ("matched", "unmatched_statement", "unmatched_ledger"):
        out = out.unionByName(spark.read.parquet(f"{path}/{name}").groupBy("session_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)))
    return out


@query("""SELECT 'book' || (o_custkey % 6) AS book, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS value_date, o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'C' END AS sign, 'REF' || o_orderkey AS our_ref, o_orderpriority AS booking_text_1 FROM orders""")
def source_statement_sheet(spark, d):
    """Statements written as workbooks, one of each six broken, and read back; a broken workbook is an error row and ends nothing."""
    o = D.table(spark, d, "orders")
    sheet = o.select(
        F.concat(F.lit("book"), F.col("o_custkey") % 6).alias("tab"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Value Date"), F.col("o_totalprice").alias("Amount"), F.when(F.col("o_orderstatus") == "F", "D").otherwise("C").alias("Sign"),
        F.lit("").alias("Origin"), F.lit("Other").alias("Type"), F.lit("").alias("Status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Book Date"), F.concat(F.lit("REF"), "o_orderkey").alias("Our Ref"), F.lit("").alias("Their Ref"), F.col("o_orderpriority").alias("Text 1"), F.lit("").alias("Text 2"),
    )
    books = tables.workbooks(sheet, "tab", 2000).select(F.concat_ws("-", "tab", "part").alias("path"), "content")
    broken = books.select(F.concat(F.lit("broken-"), "path").alias("path"), F.expr("substring(content, 1, 300)").alias("content"))
    cells = xlsx.rows(books.unionByName(broken))
    return xlsx.parsed_statement(cells).select(F.split_part("path", F.lit("-"), F.lit(1)).alias("book"), "value_date", "amount", "sign", "our_ref", "booking_text_1")


@query("WITH " + D.ITEMS + """ SELECT category AS key, count(*) AS n FROM items WHERE status = 'open' GROUP BY 1""")
def sink_certificate(spark, d):
    """A certificate's frozen figures, read back from their JSON text."""
    figures = D.items(spark, d).where("status = 'open'").groupBy(F.col("category").alias("key")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).withColumn("metric", F.lit("category"))
    path = f"{shared_folder(spark)}/certificate-{uuid.uuid4().hex}"
    tables.certificate(figures, path)
    back = spark.read.json(f"{path}/snapshot").select(F.explode(F.from_json("snapshot", "array<struct<metric:string,key:string,n:long,amount:double>>")).alias("f"))
    return back.select("f.key", "f.n")


@query("WITH " + _MT_FROM + """ SELECT 'REF' || o_orderkey AS our_ref, round(o_totalprice, 2) AS amount FROM f JOIN orders ON o_custkey = c WHERE o_orderkey % 7 <> 0""")
def sink_statement(spark, d):
    """Statement rows exported in their twelve columns as delimited text, and read back."""
    path = f"{shared_folder(spark)}/statement-{uuid.uuid4().hex}"
    tables.export_csv(tables.statement_columns(mt.lines(mt.messages(_mt_files(spark, d)))), path)
    return spark.read.option("header", True).csv(path).select("our_ref", F.col("amount").cast("double").alias("amount"))


@query("SELECT CAST(user_id % 20 AS VARCHAR) AS actor, count(*) AS n FROM events GROUP BY 1")
def sink_audit(spark, d):
    """A log that only grows: two appends, read back."""
    e = D.table(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("actor"), "event_id")
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        tables.append_audit(e.where(part), path)
    return spark.read.schema("actor string, event_id long").parquet(path).groupBy("actor").agg(F.count("*").alias("n"))


@query("""SELECT name, name LIKE '%1' AS xlsx FROM (SELECT c_name AS name FROM customer)""")
def file_magic(spark, d):
    """Workbooks by their first four bytes, whatever the file is called."""
    name = F.col("c_name")
    content = F.when(name.like("%1"), F.concat(F.lit(files.XLSX_MAGIC), F.encode(name, "UTF-8"))).otherwise(F.encode(F.concat(F.lit("PK"), name), "UTF-8"))
    return D.table(spark, d, "customer").select(name.alias("name"), F.coalesce(files.is_xlsx(content), F.lit(False)).alias("xlsx"))


@query("""SELECT c_custkey // 3 AS pair, min(c_nationkey) = max(c_nationkey) AS one_account, min(c_mktsegment) = max(c_mktsegment) AS one_currency FROM customer GROUP BY 1""")
def file_pair_valid(spark, d):
    c = D.table(spark, d, "customer")
    rows = c.select(F.floor(F.col("c_custkey") / 3).alias("pair"), F.col("c_name").alias("file"), F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("ccy"))
    return files.valid_pair(rows, "pair")


# -- files ---------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT c_custkey AS k, 'file_' || c_custkey AS name FROM customer)
SELECT name, CASE WHEN k % 10 = 0 THEN 'duplicate' WHEN k % 10 = 1 THEN 'unregistered' WHEN k % 10 = 2 THEN 'mismatch' WHEN k % 10 = 3 THEN 'no_partner' WHEN k % 10 = 4 THEN 'already_seeded' ELSE 'ingested' END AS status FROM f""")
def file_triage(spark, d):
    k = F.col("c_custkey")
    f = D.table(spark, d, "customer").select(F.concat(F.lit("file_"), k).alias("name"), F.sha2(k.cast("string"), 256).alias("sha256"), F.concat(F.lit(" A"), k).alias("account"), F.when(k % 10 == 2, "eur").otherwise("usd ").alias("ccy"), (k % 10 != 3).alias("has_partner"), k.alias("k"))
    registry = f.where("k % 10 <> 1").select("account", F.lit("USD").alias("ccy"), (F.col("k") % 10 == 4).alias("seeded"))
    return files.triaged(f.drop("k"), f.where("k % 10 = 0").select("sha256"), registry).select("name", "status")


@query("""WITH l AS (SELECT c_nationkey AS account, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS n FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_nationkey AS account, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS n FROM customer WHERE c_custkey % 2 = 1)
SELECT coalesce(l.account, r.account) AS account, l.name AS l_name, r.name AS r_name, CASE WHEN l.name IS NULL OR r.name IS NULL THEN 'no_partner' ELSE 'paired' END AS status FROM l FULL JOIN r ON l.account = r.account AND l.n = r.n""")
def file_pairing(spark, d):
    c = D.table(spark, d, "customer").select(F.col("c_nationkey").alias("account"), F.col("c_name").alias("name"), "c_custkey")
    return files.paired(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")).select("account", "l_name", "r_name", "status")


@query("""SELECT c_name AS name, CASE WHEN c_name LIKE '%7' AND c_name LIKE '%11%' THEN NULL WHEN c_name LIKE '%7' THEN 'seven' WHEN c_name LIKE '%11%' THEN 'eleven' END AS profile FROM customer""")
def file_routing(spark, d):
    return files.routed(D.table(spark, d, "customer").select(F.col("c_name").alias("name")), {"seven": "CUSTOMER*7", "eleven": "*11*"}).select("name", "profile")


@query("""SELECT 'x1234_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '_20240101.csv' AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS account_id FROM supplier""")
def account_by_digits(spark, d):
    k = F.col("s_suppkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    s = D.table(spark, d, "supplier")
    return files.account_by_digits(s.select(F.concat(F.lit("x1234_"), digits, F.lit("_20240101.csv")).alias("name")), s.where("s_suppkey % 2 = 0").select(digits.alias("ledger_account"), k.alias("account_id"))).select("name", "account_id")


@query("""SELECT min(c_name) AS name, c_nationkey AS content FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 2""")
def new_files(spark, d):
    c = D.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_name").alias("path"), F.col("c_nationkey").alias("content"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("sha256"))
    return files.new_files(c, c.where("content % 4 = 0").select("sha256").distinct()).select("name", "content")


@query("""SELECT o_custkey % 10 AS account_id, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS opening, count(*) AS rows FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY 1""")
def balance_before(spark, d):
    o = D.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("account_id"), F.when(F.col("o_orderstatus") == "F", "DR").otherwise("CR").alias("type"), F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("value_date"))
    return files.balance_before(o, 19950601, ["account_id"])


# -- functions ---------------------------------------------------------------------------------------------------------

_JUNK = ("12abc34", "12/05/2024", "1 USD 5", "12-", "", "()", "1.2.3", "1,2,3", "--5", "$", "1e5", "4 5/6")
_FINE = {"(1,234.50)": -1234.5, "1.234,5": 1234.5, "USD 12": 12.0, "7 KES": 7.0, "-€ 3,5": -3.5, "€-3.5": -3.5, "1 234.5": 1234.5, ".5": 0.5, "12.": 12.0, "+8": 8.0, "1,23,456.0": 123456.0, "(-5)": 5.0}


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 24 AS i FROM orders) SELECT o_orderkey, CAST(CASE i WHEN 12 THEN -1234.5 WHEN 13 THEN 1234.5 WHEN 14 THEN 12.0 WHEN 15 THEN 7.0 WHEN 16 THEN -3.5 WHEN 17 THEN -3.5 WHEN 18 THEN 1234.5 WHEN 19 THEN 0.5 WHEN 20 THEN 12.0 WHEN 21 THEN 8.0 WHEN 22 THEN 123456.0 WHEN 23 THEN 5.0 END AS DOUBLE) AS amount FROM t""")
def parse_amount_dirty(spark, d):
    """Dates, letters, two numbers and lone marks are no amounts; brackets, signs, marks and both separators are read."""
    shown = F.element_at(F.array(*map(F.lit, (*_JUNK, *_FINE))), (F.col("o_orderkey") % 24 + 1).cast("int"))
    return D.table(spark, d, "orders").select("o_orderkey", amounts.parse_amount(shown).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN CAST(strftime(o_orderdate, '%Y%d%m') AS INTEGER) ELSE CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) END AS day FROM orders""")
def parse_us_date(spark, d):
    """Month before day is read where day before month fits nothing."""
    return D.table(spark, d, "orders").select("o_orderkey", dates.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'D' END END AS sign, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 1000.25::DOUBLE END AS amount, CASE WHEN c_custkey % 5 <> 0 THEN 20260417 END AS date FROM customer""")
def balance_text(spark, d):
    k = F.col("c_custkey")
    shown = F.concat(F.when(k % 2 == 0, "C").otherwise("D"), F.lit(" USD "), F.format_number(k * 1000.25, 2), F.when(k % 5 == 0, F.lit(" at ")).otherwise(" on "), F.lit("20260417"))
    return D.table(spark, d, "customer").select("c_custkey", amounts.balance_text(shown).alias("b")).select("c_custkey", "b.sign", "b.amount", "b.date")


@query("""SELECT o_orderkey, abs(x) AS amount, CASE WHEN (x < 0) = (o_orderstatus = 'F') THEN 'CR' ELSE 'DR' END AS type, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END || format('{:,.2f}', abs(x)) AS shown
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice - 200000 AS x FROM orders)""")
def amount_display(spark, d):
    x, kind = F.col("o_totalprice") - 200000, F.when(F.col("o_orderstatus") == "F", "DR").otherwise("CR")
    amount, flipped = amounts.flip_reversal(x, kind)
    return D.table(spark, d, "orders").select("o_orderkey", amount.alias("amount"), flipped.alias("type"), amounts.signed_display(x, kind).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pay ' || trim(o_orderpriority) || ' now' WHEN o_orderkey % 3 = 1 THEN trim(o_orderpriority) ELSE 'one ' || trim(o_orderpriority) END AS merged FROM orders""")
def merged_description(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    a = F.when(k % 3 == 0, F.concat(F.lit("pay "), F.trim(p), F.lit(" now"))).when(k % 3 == 1, F.lit("")).otherwise("one")
    return D.table(spark, d, "orders").select("o_orderkey", text.merged_description(a, p).alias("merged"))


@query("""SELECT c_custkey, '411111' AS first6, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS last4, CASE WHEN c_custkey % 2 = 0 THEN '411111***' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS kept FROM customer""")
def masked_cards(spark, d):
    k = F.col("c_custkey")
    shown = F.concat(F.lit("411111***"), F.lpad((k % 10000).cast("string"), 4, "0"))
    first, last = pan.split_masked(shown)
    safe = pan.refuse(D.table(spark, d, "customer").select("c_custkey", first.alias("first6"), last.alias("last4"), F.when(k % 2 == 0, shown).alias("kept")), ["kept"])
    return safe


#: Rules of invented accounts: (account, priority, source, pattern, group, target, module, unless_own).
_NARRATIONS = [
    ("0", 1, "narration", r"(\d+)", 1, "text_1", None, None), ("0", 1, "narration", r"(\w*QFM\w+)", 1, "ref", None, "QFM"),
    ("1", 2, "narration", r"no (\d{4})", 1, "text_1", None, None), ("1", 1, "narration", r"(LOT)-(\d{10})", 2, "text_1", None, None),
    ("2", 1, "narration", r"slip (\d{12})", 1, "text_1", "TILL", None), ("2", 2, "user_ref", r"(.+)", 1, "text_1", None, None),
    ("3", 1, "narration", r"<([^>]*)>", 1, "text_1", None, None),
]


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'of 55  aQFM' || o_orderkey || ' to' WHEN 1 THEN 'no 1234 LOT-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') WHEN 2 THEN 'by slip ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
  WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'at <shop ' || o_orderkey || '>' ELSE 'nothing here' END ELSE repeat('x', 40) || o_orderkey END AS n FROM orders), c AS (SELECT k, replace(n, '  ', ' ') AS n FROM t)
SELECT k, CASE k % 5 WHEN 0 THEN '55' WHEN 1 THEN lpad(CAST(k AS VARCHAR), 10, '0') WHEN 2 THEN CASE WHEN k % 2 = 0 THEN lpad(CAST(k AS VARCHAR), 12, '0') ELSE 'user ' || k END WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'shop ' || k ELSE '' END ELSE substr(n, 1, 41) END AS text_1,
 CASE WHEN k % 5 = 4 THEN substr(n, 42) ELSE n END AS text_2, CASE WHEN k % 5 = 0 AND k % 3 <> 0 THEN 'aQFM' || k END AS ref FROM c""")
def narration_parsers(spark, d):
    k = F.col("o_orderkey")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    shapes = [F.concat(F.lit("of 55  aQFM"), k, F.lit(" to")), F.concat(F.lit("no 1234 LOT-"), padded(10)), F.concat(F.lit("by slip "), padded(12)), F.when(k % 2 == 0, F.concat(F.lit("at <shop "), k, F.lit(">"))).otherwise("nothing here"), F.concat(F.lit("x" * 40), k)]
    rows = D.table(spark, d, "orders").select(
        k.alias("k"), (k % 5).cast("string").alias("account"), F.element_at(F.array(*shapes), (k % 5 + 1).cast("int")).alias("narration"),
        F.when(k % 3 == 0, "T-QFM1").otherwise("T1").alias("own_ref"), F.concat(F.lit("user "), k).alias("user_ref"), F.when(k % 2 == 0, "TILL").otherwise("NET").alias("module"),
    )
    rules = spark.createDataFrame(_NARRATIONS, "account string, priority int, source string, pattern string, `group` int, target string, module string, unless_own string")
    return narration.extracted(rows, rules).select("k", "text_1", "text_2", "ref")
