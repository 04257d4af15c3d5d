"""Readers for what comes as files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.functions.ingest import clean_headers, kept_headers
from talentloom.functions.text import collapsed
from talentloom.operators.tables import first_spelling

SPREADSHEETS = (".csv", ".xlsx", ".xlsm")
TEXTS = (".txt", ".docx")
_CELLS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def csv_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with cleaned column names; cells are strings, blank ones null, and rows without any value are left out.

    With ``multi_line`` quoted cells may hold line ends and doubled quotes; a file is one task's then, as its rows can't be told apart from the middle.
    """
    reader = spark.read.option("multiLine", multi_line).option("escape", '"' if multi_line else "\\")
    df = reader.option("header", True).option("inferSchema", False).csv(path)
    heads = reader.option("header", False).csv(path).first()
    named = [str(x) if x is not None else f"column {i}" for i, x in enumerate(heads)] if heads else df.columns
    kept = kept_headers(named)
    df = df.toDF(*(str(i) for i in range(len(df.columns)))).select(*(F.col(str(i)) for i in kept)).toDF(*clean_headers([named[i] for i in kept]))
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns)).dropna("all")


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The file of each sheet by its name, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in book.namelist() else {}
    sheets = [(x.get("name"), links.get(x.get(_LINK), f"worksheets/sheet{i}.xml")) for i, x in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_CELLS}sheet"), 1)] if "xl/workbook.xml" in book.namelist() else []
    found = {name: target.lstrip("/") if target.startswith("/") else f"xl/{target}" for name, target in sheets}
    return found or {n: n for n in sorted(book.namelist()) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)}


def _sheet(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Rows of a workbook's sheet, the first one if none is named."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = ["".join(t.text or "" for t in s.iter(f"{_CELLS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        sheets = _sheets(book)
        first = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_CELLS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_CELLS}c"):
                value, kind = c.find(f"{_CELLS}v"), c.get("t")
                said = "".join(t.text or "" for t in c.iter(f"{_CELLS}t")) if kind == "inlineStr" else None if value is None else texts[int(value.text)] if kind == "s" else value.text
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = said
            rows.append(cells)
        return rows


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """``path, at, sheet`` of every workbook, in its order; files that are no workbooks have no rows."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        out += [(name, i, s) for i, s in enumerate(_sheets(book))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    pass
            yield pd.DataFrame(out, columns=["path", "at", "sheet"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, at long, sheet string")


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, kind, is_supported``: what a file is taken for, by the end of its name; files without content are passed over."""
    end = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(end.isin(*SPREADSHEETS), "spreadsheet").when(end.isin(*TEXTS), "text").otherwise("other")
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), kind.alias("kind"), (kind != "other").alias("is_supported"))


def workbook_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """``path, row, cells`` (a map by cleaned header) of workbooks' sheets of a name, or their first ones; a file that can't be read has one row with an ``error``. Of repeated headers the first stays."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                try:
                    rows = _sheet(content, sheet)
                    kept = kept_headers([h or "" for h in rows[0]]) if rows else []
                    heads = clean_headers([rows[0][i] or "" for i in kept])
                    out = [(name, i, {h: v.strip() for h, v in zip(heads, (r[i] if i < len(r) else None for i in kept)) if h and v and v.strip()}, None) for i, r in enumerate(rows[1:], 1)]
                    out = [x for x in out if x[2]]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as bad:
                    out = [(name, 0, {}, f"{type(bad).__name__}: {bad}")]
                yield pd.DataFrame(out, columns=["path", "row", "cells", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, row long, cells map<string,string>, error string")


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, error`` of .txt and .docx files, with white space collapsed. Other kinds are named in ``error``."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    if name.lower().endswith(".docx"):
                        with zipfile.ZipFile(io.BytesIO(content)) as f:
                            root = ElementTree.fromstring(f.read("word/document.xml"))
                        out.append((name, "\n".join("".join(t.text or "" for t in p.iter(f"{_WORDS}t")) for p in root.iter(f"{_WORDS}p")), None))
                    elif name.lower().endswith(".txt"):
                        out.append((name, content.decode("utf-8", "replace"), None))
                    else:
                        out.append((name, None, "unsupported kind"))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as bad:
                    out.append((name, None, f"{type(bad).__name__}: {bad}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, text string, error string").withColumn("text", collapsed(F.col("text")))


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of a JSON list of strings, without regard to case, the first spelling of each in the list's order."""
    listed = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "value"))
    return first_spelling(listed.filter("trim(value) <> ''"), "value", ["at"]).orderBy("at").select("value")
