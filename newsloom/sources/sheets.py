"""Rows of workbooks: sheets of zipped XML, read by tasks as they are parsed, a workbook at a time."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, sheet string, row long, cells array<string>"
#: Rows of a batch.
STEP = 5000
# Numbers of the formats that are built in for dates and times, and parts of own ones that say so.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_LETTERS = re.compile(r"[ymdhs]", re.I)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def elements(book: zipfile.ZipFile, name: str, wanted: set[str]) -> Iterator:
    """The wanted elements of a part when they end; each is emptied after it was used. None where the part is not there."""
    if name not in book.namelist():
        return
    with book.open(name) as raw:
        for _, element in iterparse(raw):
            if local(element.tag) in wanted:
                yield element
                element.clear()


def text_of(element) -> str:
    """The text of a string, of all its runs but those that say how it is read aloud."""
    return "".join(t.text or "" for run in element.iter() if local(run.tag) == "r" or run is element for t in run if local(t.tag) == "t")


def date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style is one of a date."""
    own, out = {}, []
    for e in elements(book, "xl/styles.xml", {"numFmt", "cellXfs"}):
        if local(e.tag) == "numFmt":
            plain = re.sub(r'"[^"]*"|\\[[^\\]]*\\]|\\\\.', "", e.get("formatCode", ""))
            own[int(e.get("numFmtId"))] = bool(DATE_LETTERS.search(plain))
        else:
            out = [own.get(n, n in DATE_FORMATS) for n in (int(x.get("numFmtId", 0)) for x in e)]
    return out


def sheet_names(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each sheet in the workbook's order, and whether days are counted from 1904."""
    parts = {e.get("Id"): e.get("Target", "") for e in elements(book, "xl/_rels/workbook.xml.rels", {"Relationship"})}
    found, late = [], False
    for e in elements(book, "xl/workbook.xml", {"sheet", "workbookPr"}):
        if local(e.tag) == "workbookPr":
            late = e.get("date1904") in ("1", "true")
        else:
            target = parts.get(next((v for k, v in e.attrib.items() if local(k) == "id"), ""), "")
            found.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found, late


def column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def value_of(cell, shared: list[str], dates: list[bool], late: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((text_of(e) for e in cell if local(e.tag) == "is"), None)
    raw = next((e.text for e in cell if local(e.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    style = int(cell.get("s", 0))
    if kind == "n" and style < len(dates) and dates[style]:
        moment = (datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)) + datetime.timedelta(seconds=round(float(raw) * 86400))
        return moment.date().isoformat() if float(raw) == int(float(raw)) else moment.isoformat(sep=" ")
    return raw


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of a workbook; cells that are not there are null, rows that are not there do not come."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [text_of(e) for e in elements(book, "xl/sharedStrings.xml", {"si"})]
        dates, (sheets, late) = date_styles(book), sheet_names(book)
        for name, part in sheets:
            for at, e in enumerate(elements(book, part, {"row"}), 1):
                cells: list[str | None] = []
                for k, cell in enumerate(c for c in e if local(c.tag) == "c"):
                    place = column(cell.get("r")) if cell.get("r") else k
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = value_of(cell, shared, dates, late)
                yield name, int(e.get("r", at)), cells


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of all workbooks of a path that Spark reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for sheet, row, cells in rows_of(content):
                    held.append((file, sheet, row, cells))
                    if len(held) == STEP:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        file, sheet, row, cells = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(sheet), pa.array(row, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def records(sheets: DataFrame, sheet: str, names: list[str]) -> DataFrame:
    """The rows of one sheet under its first row's names (trimmed; those asked for), as strings; rows without any value are
    left out, a name that the sheet lacks is null. The heads, one row a file, are broadcast."""
    own = sheets.where(F.col("sheet") == sheet)
    first = own.groupBy("file").agg(F.min("row").alias("row"))
    heads = own.join(F.broadcast(first), ["file", "row"]).select("file", F.col("row").alias("_head"), F.transform("cells", lambda c: F.btrim(c)).alias("_names"))
    met = own.join(F.broadcast(heads), "file").where(F.col("row") > F.col("_head")).where(F.exists("cells", lambda c: F.coalesce(F.btrim(c), F.lit("")) != ""))
    at = lambda n: F.get("cells", (F.nullif(F.array_position("_names", n), F.lit(0)) - 1).cast("int"))
    return met.select("file", "row", *(at(n).alias(n) for n in names))
