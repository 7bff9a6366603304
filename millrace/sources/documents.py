"""Text of DOCX and XLSX files as rows, a row for each fragment, from any file system that Spark reads.

Files are read by Spark's binary source, one a row; a task holds one file at a time. A file that is not what its
name says, is broken or goes beyond a bound gives one row with an error and no text, and the others go on; contents of
files of more than MOST_BYTES are not read at all (and so have no digest). PDF needs a library that is not there, and
is such an error.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import MOST_BYTES, MOST_UNPACKED_DOCX, WORD, Workbook, opened

# Bounds, media types, and the texts that locate a fragment.
MOST_FRAGMENTS, MOST_CHARS = 50_000, 20 << 20
OFFICE = "application/vnd.openxmlformats-officedocument."
MEDIA = {".docx": OFFICE + "wordprocessingml.document", ".xlsx": OFFICE + "spreadsheetml.sheet"}
PARAGRAPH, TABLE, TABLE_ROW, SECTION, HEADER, FOOTER, SHEET_NAME, HIDDEN = "Абзац", "Таблица", "Таблица, строка", "Раздел", "Верхний колонтитул", "Нижний колонтитул", "Лист", "Лист «{}» скрыт и включён в проверку."
SIZE = "a document has from 1 byte to 1 GiB"
FRAGMENTS = "path string, media string, size long, sha256 string, place int, id string, locator string, section string, text string, warnings array<string>, error string"


def _text(element, told: frozenset | set = frozenset()) -> str:
    """The text of an element, but for what has been told of below it."""
    if element in told:
        return ""
    own = element.text or "" if element.tag == f"{WORD}t" else ""
    return own + "".join(_text(child, told) for child in element)


def docx_fragments(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(id, locator, section, text) of paragraphs outside tables, table rows, headers and footers; numbers count blank
    ones as well. Rows of nested tables and paragraphs of text boxes come before what holds them, and are no part of it."""
    archive = opened(data, MOST_UNPACKED_DOCX)
    counts, told = {"p": 0, "tr": 0}, set()

    def walk(element, in_row: bool):
        for child in element:
            kind = child.tag.removeprefix(WORD)
            yield from walk(child, in_row or kind == "tr")
            if kind == "p" and not in_row or kind == "tr":
                counts[kind] += 1
                n = counts[kind]
                if kind == "p":
                    yield f"paragraph-{n}", f"{PARAGRAPH} {n}", f"{PARAGRAPH} {n}", _text(child, told).strip()
                else:
                    inner = nested(child)
                    cells = [c for c in child.iter(f"{WORD}tc") if c not in inner]
                    yield f"table-row-{n}", f"{TABLE_ROW} {n}", TABLE, "\t".join(_text(c, told).strip() for c in cells).strip()
                told.add(child)

    def nested(row) -> set:
        return {c for below in row.iter(f"{WORD}tr") if below is not row for c in below.iter(f"{WORD}tc")}

    yield from walk(ElementTree.fromstring(archive.read("word/document.xml")), False)
    parts = sorted(n for n in archive.namelist() if re.fullmatch(r"word/(header|footer).*\.xml", n))
    for i, name in enumerate(parts, 1):
        kind = HEADER if name.startswith("word/header") else FOOTER
        paragraphs = [_text(p).strip() for p in ElementTree.fromstring(archive.read(name)).iter(f"{WORD}p")]
        yield f"section-{i}-{kind}", f"{SECTION} {i}: {kind}", f"{SECTION} {i}", "\n".join(filter(None, paragraphs))


def xlsx_fragments(data: bytes, warnings: list[str]) -> Iterator[tuple[str, str, str, str]]:
    """(id, locator, section, text) of the rows of all sheets, located by their first and last cells; hidden sheets are read
    with a warning. A sheet whose part is missing has no rows."""
    book, shown = Workbook(data), 0
    for name, hidden, part in book.sheets():
        title = SHEET_NAME if name is None else name
        warnings += [HIDDEN.format(title)] if hidden else []
        for cells in book.rows(part) if part else ():
            if line := "\t".join(text for _, text in cells).strip():
                shown += 1
                span = ":".join(dict.fromkeys([cells[0][0], cells[-1][0]]))
                yield f"sheet-{shown}", f"{SHEET_NAME} {title}, {span}", title, line


def fragments_of(name: str, data: bytes) -> tuple[list[tuple[str, str, str, str]], list[str]]:
    """Fragments with text, and warnings; raises where the file is not to be read."""
    suffix = "." + name.rpartition(".")[2].lower()
    if not 1 <= len(data) <= MOST_BYTES:
        raise ValueError(SIZE)
    if suffix not in MEDIA or not data.startswith(b"PK\x03\x04"):
        raise ValueError("neither a DOCX nor an XLSX file")
    warnings: list[str] = []
    found, chars = [], 0
    for fragment in docx_fragments(data) if suffix == ".docx" else xlsx_fragments(data, warnings):
        if fragment[3]:
            found.append(fragment)
            chars += len(fragment[3])
        if len(found) > MOST_FRAGMENTS or chars > MOST_CHARS:
            raise ValueError("more text than a document may have")
    return found, warnings


def document_fragments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each fragment of the files (see FRAGMENTS); a file without any, or in error, has one row without text."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    (found, warnings), error = fragments_of(name, data), None
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found, warnings, error = [], [], f"{type(e).__name__}: {e}"
                rows = [(i, *f) for i, f in enumerate(found)] or [(None,) * 5]
                own = pd.DataFrame(rows, columns=["place", "id", "locator", "section", "text"]).astype({"place": "Int32"})
                yield own.assign(path=name, size=len(data), sha256=hashlib.sha256(data).hexdigest(), warnings=[warnings] * len(own), error=error)

    files = spark.read.format("binaryFile").load(path)
    kinds = "path string, size long, sha256 string, place int, id string, locator string, section string, text string, warnings array<string>, error string"
    # the bound is pushed to the source, which reads no contents beyond it
    out = files.where(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(run, kinds)
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in kinds.split(", ")}
    large = none | {"path": F.col("path"), "size": F.col("length"), "warnings": F.array().cast("array<string>"), "error": F.lit("ValueError: " + SIZE)}
    out = out.unionByName(files.where(F.col("length") > MOST_BYTES).select(*[v.alias(c) for c, v in large.items()]))
    media = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    typed = out.withColumn("media", F.when(F.col("error").isNull(), media[F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))]))
    return typed.select(*[c.split()[0] for c in FRAGMENTS.split(", ")])


def document_texts(fragments: DataFrame) -> DataFrame:
    """(path, media, size, sha256, text, warnings, error): the fragments of each file in their order, a line each. A
    file's text is bounded by what its fragments may hold."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text")))), lambda f: f["text"]), "\n")
    return fragments.groupBy("path", "media", "size", "sha256", "warnings", "error").agg(whole.alias("text"))
