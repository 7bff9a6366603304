"""CSV output in the spreadsheet dialect, and tables of XLSX and DOCX files (standard library only)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import csv_cell
from millrace.sources.delimited import read_csv, sniff_delimiter  # noqa: F401  (the reading half of write_csv)

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Bounds of archives.
MOST_UNPACKED, MOST_UNPACKED_DOCX, MOST_PARTS, MOST_RATIO = 500 << 20, 4 << 30, 50_000, 500
MOST_BYTES = 1 << 30


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with BOM, semicolons, CRLF and disarmed formulas; one file for each partition."""
    header = ";".join('"' + c.replace('"', '""') + '"' if re.search(r'["; ,\r\n]', c) else c for c in df.columns)
    cells = F.concat_ws(";", *[csv_cell(F.col(f"`{c}`").cast("string")) for c in df.columns])
    lines = df.select(cells.alias("value"), F.monotonically_increasing_id().alias("_i"))
    first = (F.col("_i") % (1 << 33)) == 0
    lines = lines.select(F.when(first, F.concat(F.lit("﻿" + header + "\r\n"), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


class UnsafeArchive(ValueError):
    """An archive that goes beyond a bound."""


def opened(data: bytes, most_unpacked: int = MOST_UNPACKED) -> zipfile.ZipFile:
    """The archive, if its parts are no more, no larger and no more compressed than they may be."""
    book = zipfile.ZipFile(io.BytesIO(data))
    parts = book.infolist()
    if len(parts) > MOST_PARTS:
        raise UnsafeArchive(f"the archive has more than {MOST_PARTS} parts")
    if sum(p.file_size for p in parts) > most_unpacked:
        raise UnsafeArchive(f"the archive unpacks to more than {most_unpacked >> 20} MiB")
    for p in parts:
        if p.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", p.filename):
            raise UnsafeArchive("the archive has a part outside of itself")
        if p.file_size > MOST_RATIO * p.compress_size > 0:
            raise UnsafeArchive(f"a part of the archive unpacks to more than {MOST_RATIO} times its size")
    return book


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


class Workbook:
    """Sheets of an XLSX file, a row at a time."""

    def __init__(self, data: bytes):
        self.archive = opened(data)
        self.parts = set(self.archive.namelist())
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in self.parts:
            self.strings = [self._letters(e) for e in self._ended("xl/sharedStrings.xml", "si")]

    @staticmethod
    def _letters(element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{SHEET}t"))

    def _ended(self, part: str, tag: str):
        """Elements of a part as they end, emptied after use."""
        with self.archive.open(part) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag == f"{SHEET}{tag}":
                    yield element
                    element.clear()

    def sheets(self):
        """(name, hidden, part) of every sheet; the part is None where it is missing."""
        relations = ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))
        parts = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))).lstrip("/") for r in relations}
        for sheet in ElementTree.fromstring(self.archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            part = parts.get(sheet.get(f"{REL}id"))
            yield sheet.get("name"), sheet.get("state", "visible") != "visible", part if part in self.parts else None

    def _shown(self, cell) -> str:
        kind = cell.get("t")
        if kind == "inlineStr":
            return self._letters(cell)
        value = cell.findtext(f"{SHEET}v") or ""
        return self.strings[int(value)] if kind == "s" and value.isdecimal() and int(value) < len(self.strings) else value

    def rows(self, part: str):
        """Each row as its cells (reference, text)."""
        for row in self._ended(part, "row"):
            yield [(c.get("r", ""), self._shown(c)) for c in row.iter(f"{SHEET}c")]


def xlsx_sheets(data: bytes) -> list[tuple[str, bool, list[list[str]]]]:
    """(name, hidden, rows of cells as text, each in its column) of every sheet."""
    book, out = Workbook(data), []
    for name, hidden, part in book.sheets():
        rows = []
        for cells in book.rows(part) if part else ():
            row: list[str] = []
            for reference, text in cells:
                row += [""] * (_column(reference) - len(row)) if reference else []
                row.append(text.strip())
            rows.append(row)
        out.append((name, hidden, rows))
    return out


def best_table(sheets: list[tuple[str, bool, list[list[str]]]]) -> tuple[str, list[list[str]]]:
    """The sheet with the best header in its first 12 rows, from the header on; the first of equals."""
    best = (0, "", [])
    for name, _, rows in sheets:
        score, start = 1, 0
        for i, row in enumerate(rows[:12]):
            low = [c.strip().lower() for c in row]
            found = 3 if "фио" in low else 2 if "номер" in low and "заказчик" in low else 0
            if found:
                score, start = found, i
                break
        if any(rows) and score > best[0]:
            best = (score, name, [r for r in rows[start:] if any(r)])
    return best[1], best[2]


def docx_table(data: bytes) -> list[list[str]]:
    """Rows of the first table outside other tables; nested ones are flattened into their cell."""
    body = ElementTree.fromstring(opened(data, MOST_UNPACKED_DOCX).read("word/document.xml")).find(f"{WORD}body")
    table = body.find(f"{WORD}tbl") if body is not None else None
    if table is None:
        return []

    def text(cell) -> str:
        out = []
        for e in cell.iter():
            if e.tag == f"{WORD}t":
                out.append(e.text or "")
            elif e.tag in (f"{WORD}tab", f"{WORD}br"):
                out.append("\t" if e.tag == f"{WORD}tab" else "\n")
            elif e.tag == f"{WORD}p" and out:
                out.append("\n")
        return "".join(out).strip()

    rows = [[text(c) for c in r.findall(f"{WORD}tc")] for r in table.findall(f"{WORD}tr")]
    rows = [r for r in rows if any(r)]
    return rows if len(rows) >= 2 else []


def office_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, cells) of the best table of XLSX and DOCX files, in any file system that Spark reads. Files of more
    than MOST_BYTES are an error, and their contents are not read."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = docx_table(data) if name.lower().endswith(".docx") else best_table(xlsx_sheets(data))[1]
                yield pd.DataFrame({"file": [name] * len(rows), "row_idx": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").load(path)
    if large := files.where(F.col("length") > MOST_BYTES).select("path").first():
        raise ValueError(f"{large.path} has more than {MOST_BYTES} bytes")
    return files.where(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(run, "file string, row_idx int, cells array<string>")
