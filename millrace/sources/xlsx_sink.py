"""XLSX output: df.write.format("millrace_xlsx").mode("overwrite").save(path) after registering XlsxSink.

Every partition streams its rows into one workbook, whatever its size: sheets hold the rows that a sheet may have, and
memory holds one row. Workbooks are written beside their places and moved there when all tasks have ended well; a job
that fails leaves nothing. Paths are those of file systems that pyarrow knows (a plain path is a local or mounted one).

Columns whose names speak of sums, costs, payments, rates or seniority hold numbers where their texts are numbers, with
spaces between digits and decimal commas. The first row is a frozen header; a column is as wide as its longest line.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Rows of a sheet, what numeric columns are called, widths, and the colours of the header.
MOST_ROWS, NUMERIC, NARROW, WIDE = 1_048_576, ("сумма", "стоимость", "оплачено", "ставка", "стаж"), 10, 45
WHITE, GREEN = "FFFFFFFF", "FF1F6D3B"
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STYLES = (
    f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/><color rgb="{WHITE}"/></font></fonts><fills count="3"><fill/><fill><patternFill patternType="gray125"/></fill>'
    f'<fill><patternFill patternType="solid"><fgColor rgb="{GREEN}"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf applyAlignment="1"><alignment wrapText="1"/></xf><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment wrapText="1"/></xf></cellXfs></styleSheet>'
)


def number(text: str) -> str | None:
    """The number that a text is, with a decimal point, or None."""
    plain = text.replace(" ", "").replace(",", ".")
    return plain if NUMBER.fullmatch(plain) else None


def column_name(at: int) -> str:
    name = ""
    while at >= 0:
        name, at = chr(65 + at % 26) + name, at // 26 - 1
    return name


class Workbook:
    """Rows into sheets of a zip file, a row at a time."""

    def __init__(self, target, header: list[str], sheet: str, most_rows: int = MOST_ROWS):
        self.archive = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
        self.header, self.sheet, self.most, self.sheets = header, sheet, most_rows, 0
        self.numeric = [any(w in h.lower() for w in NUMERIC) for h in header]
        self.columns = [column_name(i) for i in range(len(header))]
        self._begin()

    def _begin(self) -> None:
        self.body, self.row, self.widths = tempfile.TemporaryFile(), 0, [0] * len(self.header)
        self._row(self.header, 1)

    def _row(self, cells: list[str], style: int = 0) -> None:
        self.row += 1
        out = [f'<row r="{self.row}">']
        for i, text in enumerate(cells):
            self.widths[i] = max(self.widths[i], *map(len, text.splitlines() or [""]))
            value = number(text) if self.numeric[i] and not style else None
            at = f'<c r="{self.columns[i]}{self.row}" s="{style}"'
            # characters that XML has no form of are left out
            clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
            out.append(f"{at}><v>{value}</v></c>" if value else f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
        self.body.write("".join([*out, "</row>"]).encode())

    def add(self, cells: list[str]) -> None:
        if self.row == self.most:
            self._end()
            self._begin()
        self._row(cells)

    def _end(self) -> None:
        self.sheets += 1
        wide = "".join(f'<col min="{i}" max="{i}" width="{min(WIDE, max(NARROW, w)) + 2}" customWidth="1"/>' for i, w in enumerate(self.widths, 1))
        with self.archive.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True) as part:
            part.write(f'<worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{wide}</cols><sheetData>'.encode())
            self.body.seek(0)
            shutil.copyfileobj(self.body, part)
            part.write(b"</sheetData></worksheet>")
        self.body.close()

    def close(self) -> None:
        self._end()
        each = range(1, self.sheets + 1)
        names = [escape(self.sheet if i == 1 else f"{self.sheet[:25]} {i}", {'"': "&quot;"}) for i in each]
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(each, names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each) + f'<Relationship Id="rId0" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": STYLES,
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{TYPE}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{TYPE}.worksheet+xml"/>' for i in each) + "</Types>",
        }
        for name, text in parts.items():
            self.archive.writestr(name, text)
        self.archive.close()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.sheet, self.most = options.get("sheet", "Таблица")[:31], int(options.get("maxrows", MOST_ROWS))
        self.job = uuid.uuid4().hex[:12]
        # made here, once, and not by tasks: one that goes on after the job was aborted finds no folder to write to
        store, folder = self._place()
        store.create_dir(f"{folder}/_temporary-{self.job}", recursive=True)

    def _place(self):
        """The file system and the folder in it."""
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator) -> Written:
        store, folder = self._place()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.xlsx"
        temporary = f"{folder}/_temporary-{self.job}/{name}.{task.taskAttemptId()}"
        with tempfile.TemporaryFile() as local:
            book = Workbook(local, self.columns, self.sheet, self.most)
            try:
                for row in iterator:
                    book.add(["" if v is None else str(v) for v in row])
            finally:
                book.close()
            local.seek(0)
            with store.open_output_stream(temporary) as out:
                shutil.copyfileobj(local, out, 1 << 20)
        return Written(temporary, name)

    def commit(self, messages: list) -> None:
        store, folder = self._place()
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if re.fullmatch(r"part-.*\.xlsx", found.base_name):
                    store.delete_file(found.path)
        for m in done:
            store.move(m.temporary, f"{folder}/{m.name}")
        self._clear(store, folder)

    def abort(self, messages: list) -> None:
        self._clear(*self._place())

    def _clear(self, store, folder: str) -> None:
        at = f"{folder}/_temporary-{self.job}"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class XlsxSink(DataSource):
    """Options: path, sheet (its name), maxRows (rows of a sheet, the header among them)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_xlsx"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options, schema.fieldNames(), overwrite)
