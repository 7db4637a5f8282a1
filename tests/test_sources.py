"""Parsers against small files written out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sinks import tables
from tallyloom.sources import camt, csv_profile, files, mt, xlsx

MT = """{1:F01BANKDEFFAXXX0000000000}{2:I940BANKDEFFXXXXN}{4:
:20:STMT1
:25:1234567890
:28C:7/1
:60F:C240101EUR1000,00
:61:2401020103C150,25NTRFREF0000001//BANK1
extra line
:86:invoice 77
second part
:61:240103RD20,NMSCNONREF
:61:garbage
:86:belongs to no line
:61:240104D30,5NCHKCHQ-9
:62F:C240104EUR1099,75
-}"""

CAMT = """<?xml version="1.0" encoding="UTF-8"?>
<Envelope><Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt><Id>S1</Id><CreDtTm>2024-01-05T10:00:00</CreDtTm>
<Acct><Id><IBAN>DE001</IBAN></Id><Ccy>EUR</Ccy></Acct>
<Bal><Tp><CdOrPrtry><Cd>PRCD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">10.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2024-01-04</Dt></Dt></Bal>
<Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">12.50</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2024-01-05</Dt></Dt></Bal>
<Ntry><Amt Ccy="EUR">5.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2024-01-05</Dt></BookgDt><ValDt><Dt>2024-01-04</Dt></ValDt>
<NtryDtls><TxDtls><Refs><EndToEndId>E2E-1</EndToEndId><TxId>TX9</TxId></Refs><RmtInf><Ustrd>part one</Ustrd><Ustrd>part two</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry>
<Ntry><Amt Ccy="EUR">n/a</Amt><CdtDbtInd>DBIT</CdtDbtInd></Ntry>
<Ntry><NtryRef>N3</NtryRef><Amt Ccy="EUR">2.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><AcctSvcrRef>SV3</AcctSvcrRef></Ntry>
</Stmt></BkToCstmrStmt></Document></Envelope>"""


def _files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_mt_lines_and_balances(spark):
    m = mt.messages(_files(spark, a=MT, b=MT.replace("I940", "I103"), c=MT.replace("\n", "\r\n")))
    rows = mt.lines(m, keep_errors=True).orderBy("path", "row_number").collect()
    assert [(r.path, r.row_number, r.parse_error) for r in rows] == [(p, i, i == 3) for p in "ac" for i in range(1, 5)]
    one, two, _, four = rows[:4]
    assert (one.value_date, one.book_date, one.amount, one.sign, one.our_ref, one.their_ref) == (20240102, 20240103, 150.25, "C", "REF0000001", "BANK1")
    assert (one.booking_text_1, one.booking_text_2) == ("extra line", "invoice 77 second part")
    assert (two.sign, two.reversed, two.amount, two.booking_text_2) == ("D", True, 20.0, "")
    assert (four.value_date, four.amount, four.our_ref) == (20240104, 30.5, "CHQ-9")
    assert mt.lines(m).where("path = 'a'").count() == 3
    s = mt.statements(m).where("path = 'a'").first()
    assert (s.bic, s.account, s.currency, s.statement_number, s.opening.amount, s.closing.amount, s.closing.date) == ("BANKDEFF", "1234567890", "EUR", "7/1", 1000.0, 1099.75, 20240104)
    got = tables.batch_totals(mt.lines(m), mt.statements(m)).where("path = 'a'").first()
    assert (got.credits, got.debits, got.delta, got.balanced) == (150.25, 50.5, 0.0, True)


def test_camt_entries(spark):
    f = _files(spark, a=CAMT, two=CAMT.replace("<Stmt>", "<Stmt></Stmt><Stmt>", 1))
    one, three = camt.entries(f).orderBy("row_number").collect()
    assert (one.path, one.row_number, one.amount, one.sign, one.value_date, one.book_date) == ("a", 1, 5.0, "C", 20240104, 20240105)
    assert (one.our_ref, one.their_ref, one.booking_text_1) == ("E2E-1", "TX9", "part one part two")
    assert (three.row_number, three.sign, three.our_ref, three.their_ref, three.value_date) == (3, "D", "N3", "SV3", 20240105)
    s = {r.path: r for r in camt.statements(f).collect()}
    assert (s["a"].account, s["a"].currency, s["a"].opening.amount, s["a"].closing.amount, s["a"].valid) == ("DE001", "EUR", 10.0, 12.5, True)
    assert not s["two"].valid


def test_profiles(spark):
    text = 'top\nDate,Ref,Memo,Amount\n2024-01-05,R1,"a, ""b""",100.50\n\n05/01/2024,R2,x,(3.25)\nnever,R3,x,1\n2024-01-06,R4,x,abc\n'
    p = csv_profile.PRESETS["plain"]
    good, bad = csv_profile.load(_files(spark, a=text), csv_profile.Profile("p", p.columns, skip_rows=1, currency="usd"))
    rows = good.orderBy("row_number").collect()
    assert [(r.row_number, r.trn_ref, r.amount, r.type, r.value_date, r.ccy) for r in rows] == [(1, "R1", 100.5, "CR", 20240105, "USD"), (2, "R2", 3.25, "DR", 20240105, "USD")]
    assert rows[0].narration == 'a, "b"' and rows[0].extra["Memo"] == 'a, "b"'
    assert {(r.row_number, r.error) for r in bad.collect()} == {(3, "date"), (4, "amount")}
    eu, _ = csv_profile.load(_files(spark, a="Datum;Referenz;Text;Betrag\n05.01.2024;R;t;-1.234,50"), csv_profile.PRESETS["european"])
    assert [(r.amount, r.type) for r in eu.collect()] == [(1234.5, "DR")]
    two, bad = csv_profile.load(_files(spark, a="Date,Receipt,Details,Paid In,Withdrawn\n2024-01-05,A,x,5.00,\n2024-01-05,B,x,,7\n2024-01-05,C,x,,"), csv_profile.PRESETS["two columns"])
    assert [(r.trn_ref, r.amount, r.type) for r in two.orderBy("trn_ref").collect()] == [("A", 5.0, "CR"), ("B", 7.0, "DR")] and bad.count() == 1


def test_workbook_round_trip(spark):
    head = list(xlsx.LEDGER)
    body = [("R1", "05/01/2024", "DR", "text <&>", 45296, "1,000.50", "B", "A", "USD", "M", "X", "U"), (None, "05/01/2024", "DR", "", 45296, "1", "B", "A", "USD", "M", "X", "U")]
    content = tables.sheet_bytes("led", head, body)
    cells = xlsx.rows(spark.createDataFrame([("a", bytearray(content))], "path string, content binary"))
    (row,) = xlsx.ledger(cells).collect()
    assert (row.trn_ref, row.booking_date, row.value_date, row.amount, row.narration, row.row_number) == ("R1", 20240105, 20240105, 1000.5, "text <&>", 1)
    proof = tables.sheet_bytes("p", ["Account", "Reference", "Amount", "DrCr", "Value Date", "Narration"], [("77", "P1", -5, "D", "2024-01-05", "n"), (None, None, 5, None, None, None)])
    (p,) = xlsx.proof(xlsx.rows(spark.createDataFrame([("a", bytearray(proof))], "path string, content binary"))).collect()
    assert (p.account_id, p.amount, p.type, p.value_date) == ("77", 5.0, "DR", 20240105)
    bal = tables.sheet_bytes("b", ["as_of_date", "opening_balance", "closing_balance", "currency"], [("2024-01-05", 10, 12.5, "usd")])
    (b,) = xlsx.balances(xlsx.rows(spark.createDataFrame([("a", bytearray(bal))], "path string, content binary"))).collect()
    assert (b.as_of, b.opening, b.closing, b.currency) == (20240105, 10.0, 12.5, "USD")
    books = tables.workbooks(spark.range(5).withColumn("t", F.lit("x")), "t", rows_per_book=3)
    assert sum(len(list(xlsx.sheets(bytes(r.content)))) - 1 for r in books.collect()) == 5


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é€".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes("é".encode())
    got = files.load(spark, str(tmp_path)).withColumn("text", files.decoded(F.col("content")))
    assert {r.name: r.text for r in got.collect()} == {"a.txt": "é", "b.txt": "é€", "c.txt": "é"}
    assert {r.name for r in files.new_files(got, got.where("name = 'b.txt'")).collect()} == {"a.txt"}
    names = spark.createDataFrame([("x_12345678_99.csv", "1"), ("Y.TXT", "1"), ("z.csv", "2")], "name string, account string")
    assert {r.name: r.profile for r in files.routed(names, {"p": "*.CSV", "q": "z*", "r": "*.txt"}).collect()} == {"x_12345678_99.csv": "p", "Y.TXT": "r", "z.csv": None}
    acc = spark.createDataFrame([("12345678", 5)], "ledger_account string, account_id int")
    assert {r.name: r.account_id for r in files.account_by_digits(names, acc).collect()}["x_12345678_99.csv"] == 5
    pairs = files.paired(names, names.where("name = 'z.csv' or name = 'Y.TXT'")).collect()
    assert sorted((r.account, r.n, r.status) for r in pairs) == [("1", 1, "paired"), ("1", 2, "no_partner"), ("2", 1, "paired")]
    assert files.guess_columns(["Txn Date", "Description", "Amount", "Ref No"]) == {"value_date": "Txn Date", "amount": "Amount", "ref": "Ref No", "narration": "Description"}
    assert files.is_xlsx is not None and pytest


def test_quoted_line_breaks_and_lone_quotes(spark):
    from tallyloom.sources import csv_profile

    text = 'Date,Ref,Memo,Amount\r\n2024-01-05,A1,"two\nlines, ""quoted""",5.00\r\n2024-01-06,A2,5" pipe,6.00\n\n2024-01-07,A3,"open,7.00\n2024-01-08,A4,x,12/05/2024\n'
    good, bad = csv_profile.load(spark.createDataFrame([("f", text)], "path string, text string"), csv_profile.PRESETS["plain"])
    got = {x.trn_ref: (x.narration, x.amount) for x in good.collect()}
    assert got["A1"] == ('two\nlines, "quoted"', 5.0) and got["A2"] == ('5" pipe', 6.0) and got["A3"] == ('"open', 7.0)
    assert [(x.row_number, x.error) for x in bad.collect()] == [(4, "amount")]


def test_a_malformed_camt_file_is_an_error_row(spark):
    from tallyloom.sources import camt

    fine = '<Document xmlns="urn:x"><A><Stmt><Id>S</Id><Ntry><Amt Ccy="EUR">5.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Ntry></Stmt></A></Document>'
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]>' + fine
    files = spark.createDataFrame([("fine", fine), ("cut", fine[:50]), ("bomb", bomb), ("null", None), ("two", fine.replace("</A>", "<Stmt/></A>"))], "path string, text string")
    assert [(x.path, x.amount) for x in camt.entries(files).collect()] == [("fine", 5.0)]
    assert {x.path: x.error for x in camt.statements(files).collect()} == {"fine": None, "cut": "not well-formed", "bomb": "document type declared", "null": "not well-formed", "two": "2 statements"}


def test_sheets_are_found_by_relationship(spark):
    import io
    import zipfile

    from tallyloom.sinks.tables import sheet_bytes
    from tallyloom.sources import xlsx

    one, two = (zipfile.ZipFile(io.BytesIO(sheet_bytes(n, ["h"], [(n,)]))) for n in ("first", "second"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}"><sheets><sheet name="first" sheetId="1" r:id="r9"/><sheet name="second" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="/xl/worksheets/sheet7.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", two.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet7.xml", one.read("xl/worksheets/sheet1.xml"))
    rows = xlsx.rows(spark.createDataFrame([("b", bytearray(out.getvalue()))], "path string, content binary")).where("row = 2").collect()
    assert {(x.sheet_name, x.cells[0]) for x in rows} == {("first", "first"), ("second", "second")}


def test_every_message_of_a_file_is_read(spark):
    from tallyloom.sources import mt

    one = "{1:F01A}{2:I940BANKGB2LXXXXN}{4:\n:20:A\n:25:ACC\n:28C:1\n:60F:C240101USD10\n:61:2401050106D5,NTRFREF1//B1\nmore\n:86:paid\n:61:240105C,5NTRFREF2\n:61:240106RD7,25NTRFREF 3\n:62F:C240131USD5,\n-}"
    m = mt.messages(spark.createDataFrame([("f", one + "\n" + one.replace("REF1", "REF9"))], "path string, text string"))
    got = [(x.path, x.row_number, x.amount, x.sign, x.reversed, x.book_date, x.our_ref, x.their_ref, x.booking_text_1, x.booking_text_2) for x in mt.lines(m).orderBy("path", "row_number").collect()]
    first = [("f", 1, 5.0, "D", False, 20240106, "REF1", "B1", "more", "paid"), ("f", 3, 7.25, "D", True, 20240106, "REF 3", "", "", "")]
    assert got == first + [("f#2", *first[0][1:6], "REF9", *first[0][7:]), ("f#2", *first[1][1:])]
    assert [(x.path, x.opening.amount, x.closing.amount) for x in mt.statements(m).orderBy("path").collect()] == [("f", 10.0, 5.0), ("f#2", 10.0, 5.0)]


def test_an_empty_folder_streams_nothing(spark, tmp_path):
    from tallyloom.streaming import flows

    assert flows.drained(flows.daily(flows.events(spark, str(tmp_path))), "complete", merge=flows.last_batch).count() == 0


def test_repeated_and_blank_headers_keep_their_first_place(spark):
    text = "Date,Ref,Memo,Amount,Ref,,\n2024-01-05,R1,m,5.00,other,,\n2024-01-06,R2,m,6.00\n"
    good, bad = csv_profile.load(_files(spark, a=text), csv_profile.PRESETS["plain"])
    assert sorted((r.trn_ref, r.amount) for r in good.collect()) == [("R1", 5.0), ("R2", 6.0)] and bad.count() == 0


def test_broken_workbooks_are_error_rows(spark):
    import io
    import zipfile

    def book(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in parts.items():
                z.writestr(name.replace("__", "/"), data)
        return out.getvalue()

    fine = tables.sheet_bytes("led", list(xlsx.LEDGER), [("R1", "05/01/2024", "DR", "t", "05/01/2024", "1", "B", "A", "USD", "M", "X", "U")])
    cases = {"fine": fine, "cut": fine[:200], "none": b"no archive", "empty": book(), "bomb": book(**{"xl/_rels/workbook.xml.rels": "<!DOCTYPE x><r/>", "xl/workbook.xml": "<w/>"}),
             "lost": book(**{"xl/_rels/workbook.xml.rels": "<r/>", "xl/workbook.xml": '<w xmlns:r="x"><sheet name="a" r:id="r9"/></w>'})}
    cells = xlsx.rows(spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary"))
    assert {r.path for r in cells.where("error is not null").collect()} == set(cases) - {"fine"}
    assert [r.trn_ref for r in xlsx.ledger(cells).collect()] == ["R1"]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    """Line by line as whole: numbers, headers of several files, blank lines, quoted delimiters."""
    p = csv_profile.Profile("p", csv_profile.PRESETS["plain"].columns, skip_rows=1)
    texts = {}
    for f, n in (("a", 9000), ("b", 3), ("c", 0)):
        head = "top\n\nDate,Ref,Memo,Amount,,\n" if f != "b" else "top\r\nRef,Date,Amount,Memo\r\n"
        body = "".join(f'2024-01-05,{f}{i},"m, {i}",{i}.50,,\n' + ("\n" if i % 50 == 0 else "") for i in range(n)) if f != "b" else "".join(f"{f}{i},2024-01-06,{i},x\r\n" for i in range(n))
        texts[f] = head + body
        (tmp_path / f).write_text(texts[f], newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 5
        got = csv_profile.read_lines(spark, f"file://{tmp_path}", p)
        shown = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.row_number, sorted(r.extra.items())) for r in df.collect())
        assert shown(got) == shown(csv_profile.rows(_files(spark, **texts), p)) and got.count() == 9003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
