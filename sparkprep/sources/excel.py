"""Excel workbooks (.xlsx): every workbook is decoded by one task, many workbooks in parallel.

Spark has no workbook source, so ``mapInPandas`` streams the sheet XML out of the zip container. A
sheet holds at most 1,048,576 rows by format, which bounds the work of a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.parsing import READER_NULL_TOKENS, trim_text

# Fixed values of the file format: XML names and the built-in number formats that show dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
DATE_FORMAT_IDS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))
EPOCH = datetime(1899, 12, 30)

BATCH = 5_000
ROW_SCHEMA = "path string, sheet int, row long, cells map<string,string>"
HEADER_SCHEMA = "path string, sheet int, position int, name string"


def read_excel(
    spark: SparkSession, path: str | Sequence[str], null_tokens: Sequence[str] = READER_NULL_TOKENS
) -> DataFrame:
    """All sheets of all workbooks as text, stacked by column name, missing columns NULL."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    headers = files.mapInPandas(_headers, HEADER_SCHEMA)
    first_seen = headers.groupBy("name").agg(F.min(F.struct("path", "sheet", "position")).alias("at"))
    names = [row["name"] for row in first_seen.orderBy("at").collect()]  # column names only
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    rows = files.mapInPandas(_rows, ROW_SCHEMA)
    tokens = list(null_tokens)
    cell = lambda n: F.col("cells").getItem(n)
    table = rows.select(*[F.when(~cell(n).isin(tokens), cell(n)).alias(f"_c{i}") for i, n in enumerate(names)])
    table = table.na.drop("all")
    return table.select(*[trim_text(F.col(c)).alias(c) for c in table.columns]).toDF(*names)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, content in _files(batches):
        found = []
        for sheet, rows in enumerate(_sheets(content)):
            header = _header_names(next(rows, []))
            if next(rows, None) is not None:  # a sheet without rows is skipped
                found += [(path, sheet, i, name) for i, name in enumerate(header)]
        yield pd.DataFrame(found, columns=["path", "sheet", "position", "name"])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "row", "cells"]
    for path, content in _files(batches):
        for sheet, rows in enumerate(_sheets(content)):
            header = _header_names(next(rows, []))
            batch = []
            for number, cells in enumerate(rows):
                record = {name: value for name, value in zip(header, cells) if value is not None}
                batch.append((path, sheet, number, record))
                if len(batch) == BATCH:
                    yield pd.DataFrame(batch, columns=names)
                    batch = []
            yield pd.DataFrame(batch, columns=names)


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch["path"], batch["content"])


def _header_names(cells: Sequence[str | None]) -> list[str]:
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        seen.setdefault(name, 0)
        names.append(name)
    return names


def _sheets(content: bytes) -> Iterator[Iterator[list[str | None]]]:
    """The rows of each sheet, in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = _shared_texts(book)
        dates = _date_styles(book)
        for part in _sheet_parts(book):
            with book.open(part) as xml:
                yield _sheet_rows(xml, texts, dates)


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_parts(book: zipfile.ZipFile) -> list[str]:
    targets = {
        r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels").iter(RELATION)
    }
    parts = []
    for sheet in _part(book, "xl/workbook.xml").iter(f"{MAIN}sheet"):
        target = targets[sheet.get(RELATION_ID)]
        parts.append(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    return [p for p in parts if "worksheets/" in p]


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indices of the cell styles that show a date or time."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{MAIN}numFmt")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())
    }
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, number in enumerate(ids) if number in DATE_FORMAT_IDS | custom}


def _sheet_rows(xml, texts: list[str], dates: set[int]) -> Iterator[list[str | None]]:
    for _, element in ElementTree.iterparse(xml):
        if element.tag != f"{MAIN}row":
            continue
        cells: list[str | None] = []
        for cell in element.iter(f"{MAIN}c"):
            place = _column_number(cell.get("r"), len(cells))
            cells += [None] * (place - len(cells))
            cells.append(_cell_text(cell, texts, dates))
        element.clear()
        yield cells


def _column_number(reference: str | None, default: int) -> int:
    """Zero-based column of a reference such as AB12."""
    if not reference:
        return default
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_text(cell, texts: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return texts[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "d"):
        return value
    if kind == "e":
        return None
    number = float(value)
    if int(cell.get("s", 0)) in dates:
        moment = EPOCH + timedelta(microseconds=round(number * 86_400_000_000))
        return str(moment.replace(microsecond=0))
    return str(int(number)) if number.is_integer() else repr(number)
