"""Reports and stores as files: exports, tabbed workbooks, sessions, an append-only log, spreadsheets."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ledger, reviews


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_sessions(df: DataFrame, path: str) -> None:
    """Rows of sessions, a folder for each. A session that is written again replaces its own folder; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """The log only grows: there is no function that rewrites it."""
    df.write.mode("append").parquet(path)


def write_tabs(df: DataFrame, tab: str, path: str) -> None:
    """A folder for each tab of a report."""
    df.write.mode("overwrite").partitionBy(tab).option("header", True).csv(path)


def one_sided(items: DataFrame, chain: DataFrame, path: str) -> None:
    """A one-sided account's book: a summary, its open items, and its files with their anchors and continuity."""
    open_ = items.where("status = 'open'")
    summary = open_.groupBy("account_id", "sign").agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("amount"))
    for name, df in (("summary", summary), ("items", open_), ("continuity", ledger.continuity(chain))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def certificate(figures: DataFrame, path: str) -> None:
    """A certificate's figures as a table, and as the one JSON text that is frozen when it is signed."""
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    reviews.snapshot(figures).write.mode("overwrite").json(f"{path}/snapshot")


def two_sided(summary: DataFrame, matched: DataFrame, left: DataFrame, right: DataFrame, path: str) -> None:
    for name, df in (("summary", summary), ("matched", matched), ("unmatched_statement", left), ("unmatched_ledger", right)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def statement_columns(lines: DataFrame) -> DataFrame:
    """The twelve columns of an exported statement: a file's rows together and in order."""
    names = ("row_number", "value_date", "amount", "sign", "origin", "type", "status", "book_date", "our_ref", "their_ref", "booking_text_1", "booking_text_2")
    return lines.repartition("path").sortWithinPartitions("path", "row_number").select(*names)


def batch_totals(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """Per file: rows, credits, debits, and whether opening plus movements is closing."""
    credit = F.when(F.col("sign") == "C", F.col("amount")).otherwise(0.0)
    sums = lines.groupBy("path").agg(F.count("*").alias("rows"), F.sum(credit).alias("credits"), F.sum(F.col("amount") - credit).alias("debits"))
    side = lambda b: F.when(F.col(f"{b}.sign") == "C", F.col(f"{b}.amount")).otherwise(-F.col(f"{b}.amount"))
    out = statements.join(sums, "path", "left").na.fill(0, ["rows", "credits", "debits"])
    delta = F.round(side("opening") + F.col("credits") - F.col("debits") - side("closing"), 4)
    return out.select("path", "account", "rows", F.round("credits", 2).alias("credits"), F.round("debits", 2).alias("debits"), delta.alias("delta"), (F.abs(delta) < 0.01).alias("balanced"))


def sheet_bytes(name: str, header: list[str], rows: list[tuple]) -> bytes:
    """A one-sheet workbook."""
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(header), *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(name[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df: DataFrame, tab: str, rows_per_book: int = 100_000) -> DataFrame:
    """tab, part, content: the rows of each tab as workbooks of at most ``rows_per_book`` rows, made by the tasks."""
    names = [c for c in df.columns if c != tab]
    numbered = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 31)))
    sizes = df.groupBy(tab).agg(F.ceil(F.count("*") / rows_per_book).alias("_n"))
    dealt = numbered.join(sizes, tab).withColumn("_part", F.pmod("_part", F.col("_n"))).drop("_n")

    def book(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group[names].astype(object).where(group[names].notna(), None).itertuples(index=False, name=None))
        return pd.DataFrame({"tab": [str(group[tab].iloc[0])], "part": [int(group["_part"].iloc[0])], "content": [sheet_bytes(str(group[tab].iloc[0]), names, rows)]})

    return dealt.groupBy(tab, "_part").applyInPandas(book, "tab string, part long, content binary")
