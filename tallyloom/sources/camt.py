"""ISO 20022 account statements and notifications (camt.053, camt.054), whatever namespace or envelope they come in."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import dates
from tallyloom.sources.files import few_at_once

_ENTRY = "path string, row_number int, amount double, mark string, value_date string, book_date string, our_refs array<string>, their_refs array<string>, texts array<string>, info string, fallback_date string"
_META = "path string, account string, currency string, statement_ref string, balances array<struct<code:string,amount:double,mark:string,date:string>>, containers int, error string"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ET.Element, *path: str) -> list[ET.Element]:
    found = [e]
    for step in path:
        found = [c for f in found for c in f if _name(c) == step]
    return found


def _text(e: ET.Element, *path: str) -> str | None:
    return next((t for x in _all(e, *path) if (t := (x.text or "").strip())), None)


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _containers(text: str | None) -> tuple[list[ET.Element], str | None]:
    """A file's statements and notifications, or why it was refused: declarations of types or entities are never expanded."""
    text = (text or "").strip()
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return [], "document type declared"
    try:
        found = [e for e in ET.fromstring(text.encode()).iter() if _name(e) in ("Stmt", "Ntfctn")]
    except (ET.ParseError, ValueError, LookupError):
        return [], "not well-formed"
    return found, None if len(found) == 1 else f"{len(found)} statements"


def _day(e: ET.Element, tag: str) -> str | None:
    return (_text(e, tag, "Dt") or _text(e, tag, "DtTm") or "")[:10] or None


def entries(files: DataFrame) -> DataFrame:
    """path, text -> statement rows. Entries without a numeric amount are left out but keep their number.

    Own reference: end-to-end, instruction, entry reference, then UETR; theirs: servicer's, then transaction id.
    Dates fall back from value to booking to the container's. Only well-formed files of one container are read; what is
    wrong with the others is in :func:`statements`.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"]):
                boxes, why = _containers(text)
                if why:
                    continue
                box = boxes[0]
                fallback = (_text(box, "CreDtTm") or _text(box, "FrToDt", "ToDtTm") or "")[:10] or None
                for i, e in enumerate(_all(box, "Ntry"), 1):
                    refs = lambda *p: [_text(e, "NtryDtls", "TxDtls", "Refs", *p)]  # noqa: B023, E731
                    rows.append((
                        path, i, _number(_text(e, "Amt")), _text(e, "CdtDbtInd"), _day(e, "ValDt"), _day(e, "BookgDt"),
                        refs("EndToEndId") + refs("InstrId") + [_text(e, "NtryRef")] + refs("UETR"), [_text(e, "AcctSvcrRef")] + refs("AcctSvcrRef") + refs("TxId"),
                        [x.text.strip() for x in _all(e, "NtryDtls", "TxDtls", "RmtInf", "Ustrd") if (x.text or "").strip()], _text(e, "AddtlNtryInf"), fallback,
                    ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")]).astype({"our_refs": object, "their_refs": object, "texts": object})

    raw = few_at_once(files).select("path", "text").mapInPandas(read, _ENTRY).where("amount is not null")
    first = lambda c: F.coalesce(F.get(F.filter(c, lambda x: x.isNotNull() & (x != "NOTPROVIDED")), F.lit(0)), F.lit(""))
    day = lambda *c: dates.to_int(F.try_to_date(F.coalesce(*c), "yyyy-MM-dd"))
    return raw.select(
        "path", "row_number", day("value_date", "book_date", "fallback_date").alias("value_date"), F.abs("amount").alias("amount"), F.when(F.col("mark") == "CRDT", "C").otherwise("D").alias("sign"),
        F.lit("Their").alias("origin"), F.lit("Other").alias("type"), F.lit("Unmatched").alias("status"), day("book_date", "value_date", "fallback_date").alias("book_date"),
        first("our_refs").alias("our_ref"), first("their_refs").alias("their_ref"), F.concat_ws(" ", "texts").alias("booking_text_1"), F.coalesce("info", F.lit("")).alias("booking_text_2"),
    )


def statements(files: DataFrame) -> DataFrame:
    """One row per file: account, currency, opening (OPBD or PRCD, whichever is first) and closing (CLBD) balances, whether it is valid, and else the error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"]):
                boxes, why = _containers(text)
                box = boxes[0] if boxes else ET.Element("none")
                balances = [
                    {"code": _text(b, "Tp", "CdOrPrtry", "Cd"), "amount": _number(_text(b, "Amt")), "mark": _text(b, "CdtDbtInd"), "date": _day(b, "Dt") or _text(b, "Dt")} for b in _all(box, "Bal")
                ]
                ccy = _text(box, "Acct", "Ccy") or next((a.get("Ccy") for a in box.iter() if _name(a) == "Amt"), None)
                rows.append((path, _text(box, "Acct", "Id", "IBAN") or _text(box, "Acct", "Id", "Othr", "Id"), ccy, _text(box, "Id"), balances, len(boxes), why))
            yield pd.DataFrame(rows, columns=["path", "account", "currency", "statement_ref", "balances", "containers", "error"]).astype({"balances": object})

    raw = few_at_once(files).select("path", "text").mapInPandas(read, _META)
    pick = lambda *codes: F.get(F.filter("balances", lambda b: b["code"].isin(*codes)), F.lit(0))
    return raw.select("path", "account", "currency", "statement_ref", pick("OPBD", "PRCD").alias("opening"), pick("CLBD").alias("closing"), F.col("error").isNull().alias("valid"), "error")
