"""Spreadsheets as rows of cells, and the ledger, statement, balance and proof sheets in them.

The files are zip archives of XML, read by a small helper inside ``mapInPandas``, one file per row.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import amounts, dates

_CELLS = "path string, sheet int, sheet_name string, row int, cells array<string>, error string"
LEDGER = {"TRN_REF_NO": "trn_ref", "BOOKING_DATE": "booking_date", "TYPE": "type", "TXN_NARRATIONS": "narration", "VALUE_DATE": "value_date", "LCY_AMOUNT": "amount", "AC_BRANCH": "ac_branch", "AC_NO": "ac_no", "ACCT_CCY": "ccy", "MODULE": "module", "EXTERNAL_REF_NO": "external_ref", "USER_ID": "user_id"}
REQUIRED = ("TRN_REF_NO", "BOOKING_DATE", "TYPE", "TXN_NARRATIONS", "VALUE_DATE", "LCY_AMOUNT")


#: Rows of a file that are handed on at once.
AT_ONCE = 10_000
#: What a damaged or foreign archive, part or cell raises.
UNREADABLE = (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, TypeError, StopIteration, EOFError, NotImplementedError, zlib.error)


def _xml(book: zipfile.ZipFile, part: str) -> ET.Element:
    data = book.read(part)
    if b"<!DOCTYPE" in data:
        raise ValueError(f"document type declared in {part}")
    return ET.fromstring(data)


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[ET.Element]:
    """A sheet's rows, each forgotten once it is read, so that no sheet is a tree as a whole."""
    data = book.read(part)
    if b"<!DOCTYPE" in data:
        raise ValueError(f"document type declared in {part}")
    for _, e in ET.iterparse(io.BytesIO(data)):
        if _local(e) == "row":
            yield e
            e.clear()


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """(sheet's place, its name, row from 1, cells) of every row that has cells."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(book, "xl/sharedStrings.xml") if _local(s) == "si"]
    # sheets stand in the workbook's order; which part holds one is told by its relationship
    parts = {r.get("Id"): r.get("Target", "") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    listed = [s for s in _xml(book, "xl/workbook.xml").iter() if _local(s) == "sheet"]
    for i, sheet in enumerate(listed):
        name, target = sheet.get("name"), parts[next(v for k, v in sheet.items() if k.endswith("}id"))]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        for row in _rows(book, part):
            number = int(row.get("r") or number + 1)
            cells: list[str | None] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value or None)
            if any(cells):
                yield i, name, number, cells


def rows(files: DataFrame) -> DataFrame:
    """path, content -> path, sheet, sheet_name, row, cells, error.

    A file that is no readable workbook gives one row without cells that says why; its rows before the fault are not given.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    got = [(path, *r, None) for r in sheets(bytes(content))]
                except UNREADABLE as fault:
                    got = [(path, None, None, None, None, f"{type(fault).__name__}: {fault}")]
                while got:  # one file's rows at a time, and of these so many
                    found = pd.DataFrame(got[:AT_ONCE], columns=["path", "sheet", "sheet_name", "row", "cells", "error"]).astype({"cells": object})
                    del got[:AT_ONCE]
                    yield found.astype({"sheet": "Int32", "row": "Int32"})

    return files.select("path", "content").mapInPandas(read, _CELLS)


def _table(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Rows below their file's header as maps from header to cell. header: path, sheet, top, names."""
    below = cells.join(header, ["path", "sheet"]).where(F.col("row") > F.col("top"))
    pairs = F.arrays_zip("names", "cells")
    kept = F.filter(pairs, lambda p: p["names"].isNotNull())
    return below.select("path", "row", F.map_from_entries(F.transform(kept, lambda p: F.struct(F.trim(p["names"]), p["cells"]))).alias("c"))


def ledger(cells: DataFrame) -> DataFrame:
    """The first sheet's ledger rows; files without the required columns and rows without a reference give none."""
    head = cells.where("sheet = 0 and row = 1").select("path", "sheet", F.col("row").alias("top"), F.col("cells").alias("names"))
    head = head.where(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "names")) == 0)
    t = _table(cells, head)
    at = lambda h: F.element_at("c", F.lit(h))
    special = {"amount": lambda c: amounts.parse_amount(c), "booking_date": dates.parse_date, "value_date": dates.parse_date}
    cols = [(special.get(n, lambda c: F.coalesce(c, F.lit("")))(at(h))).alias(n) for h, n in LEDGER.items()]
    return t.where(F.coalesce(at("TRN_REF_NO"), F.lit("")) != "").select("path", (F.col("row") - 1).alias("row_number"), *cols)


def balances(cells: DataFrame) -> DataFrame:
    """as_of, opening, closing, currency from the sheet whose first row names them; malformed ones give no row."""
    head = cells.where((F.col("row") == 1) & F.array_contains("cells", "opening_balance")).select("path", "sheet", F.col("row").alias("top"), F.col("cells").alias("names"))
    t = _table(cells, head).where("row = 2")
    at = lambda h: F.element_at("c", F.lit(h))
    out = t.select("path", dates.parse_date(at("as_of_date")).alias("as_of"), amounts.parse_amount(at("opening_balance")).alias("opening"), amounts.parse_amount(at("closing_balance")).alias("closing"), F.upper(at("currency")).alias("currency"))
    return out.where("opening is not null and closing is not null")


def proof(cells: DataFrame, *, ref: str = "Reference", amount: str = "Amount", sign: str = "DrCr", date: str = "Value Date", narration: str = "Narration") -> DataFrame:
    """Seed rows of the first sheet whose header starts with "Account": footers, blank and reference-less rows go."""
    head = cells.where(F.trim(F.get("cells", F.lit(0))) == "Account").groupBy("path").agg(F.min(F.struct("sheet", "row", "cells")).alias("h"))
    head = head.select("path", F.col("h.sheet").alias("sheet"), F.col("h.row").alias("top"), F.col("h.cells").alias("names"))
    at = lambda h: F.element_at("c", F.lit(h))
    t = _table(cells, head).where((F.coalesce(at(ref), F.lit("")) != "") & (F.coalesce(at("Account"), F.lit("")) != ""))
    mark = F.upper(F.substring(F.trim(at(sign)), 1, 1))
    kind: Column = F.when(mark == "C", "CR").when(mark == "D", "DR")
    return t.select("path", at("Account").alias("account_id"), at(ref).alias("trn_ref"), F.abs(amounts.parse_amount(at(amount))).alias("amount"), kind.alias("type"), dates.parse_date(at(date)).alias("value_date"), F.coalesce(at(narration), F.lit("")).alias("narration"))


def parsed_statement(cells: DataFrame, first: str = "Value Date") -> DataFrame:
    """Statement rows of a workbook whose header is the row that starts with ``first``; eleven columns by place."""
    head = cells.where(F.trim(F.get("cells", F.lit(0))) == first).groupBy("path").agg(F.min(F.struct("sheet", "row")).alias("h"))
    below = cells.join(head, "path").where("sheet = h.sheet and row > h.row").where(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))) != "")
    at = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    names = ("value_date", "amount", "sign", "origin", "type", "status", "book_date", "our_ref", "their_ref", "booking_text_1", "booking_text_2")
    special = {"amount": amounts.parse_amount, "value_date": dates.parse_date, "book_date": dates.parse_date}
    return below.select("path", (F.col("row") - F.col("h.row")).alias("row_number"), *[special.get(n, lambda c: c)(at(i)).alias(n) for i, n in enumerate(names)])
