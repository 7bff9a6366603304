import hashlib
import io
import zipfile

import pytest

from millrace.sources import documents, tables

W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def write(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in {"[Content_Types].xml": "<Types/>", **parts}.items():
            z.writestr(name, text)


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"[Content_Types].xml": "<Types/>", **parts}.items():
            z.writestr(name, text)
    return out.getvalue()


def by_file(found):
    by = {}
    for x in sorted(found.collect(), key=lambda x: (x.path, x.place or 0)):
        by.setdefault(x.path.rsplit("/", 1)[1], []).append(x)
    return by


def test_docx(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    write(tmp_path / "x.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('one')}{p('')}{table}{p('three')}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{p('top')}{p('')}</w:hdr>"})
    (tmp_path / "fake.docx").write_text("not one")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "cut.xlsx").write_bytes(b"PK\x03\x04 cut off")
    found = documents.document_fragments(spark, str(tmp_path))
    by = by_file(found)
    assert [(x.id, x.locator, x.section, x.text) for x in by["x.docx"]] == [
        ("paragraph-1", "Абзац 1", "Абзац 1", "one"), ("table-row-1", "Таблица, строка 1", "Таблица", "a\tb"), ("paragraph-3", "Абзац 3", "Абзац 3", "three"), ("section-1-Верхний колонтитул", "Раздел 1: Верхний колонтитул", "Раздел 1", "top"),
    ]
    assert {x.sha256 for x in by["x.docx"]} == {hashlib.sha256((tmp_path / "x.docx").read_bytes()).hexdigest()}
    assert all(by[f][0].error and by[f][0].text is None and by[f][0].media is None for f in ("fake.docx", "z.pdf", "cut.xlsx"))
    texts = {x.path.rsplit("/", 1)[1]: x.text for x in documents.document_texts(found).collect()}
    assert texts["x.docx"] == "one\na\tb\nthree\ntop" and texts["z.pdf"] == ""


def test_nested_text_comes_once():
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    outer = f"<w:tbl><w:tr><w:tc>{p('out')}{inner}</w:tc><w:tc>{p('side')}</w:tc></w:tr></w:tbl>"
    box = f"<w:p><w:r><w:pict><w:txbxContent>{p('box')}</w:txbxContent></w:pict></w:r><w:r><w:t>body</w:t></w:r></w:p>"
    data = packed({"word/document.xml": f"<w:document {W}><w:body>{outer}{box}</w:body></w:document>"})
    assert [f[3] for f in documents.docx_fragments(data)] == ["in", "out\tside", "box", "body"]


def test_xlsx(spark, tmp_path):
    from tests.test_sources import xlsx

    book = xlsx([("План", False, [["Этап", "ФИО"], ["", ""], ["один"]]), ("Архив", True, [["", "", "старое"]])])
    (tmp_path / "book.XLSX").write_bytes(book)
    (tmp_path / "lost.xlsx").write_bytes(packed({n: zipfile.ZipFile(io.BytesIO(book)).read(n).decode() for n in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/s0.xml")}))
    by = by_file(documents.document_fragments(spark, str(tmp_path)))
    assert [(x.id, x.locator, x.section, x.text) for x in by["book.XLSX"]] == [("sheet-1", "Лист План, A1:B1", "План", "Этап\tФИО"), ("sheet-2", "Лист План, A3", "План", "один"), ("sheet-3", "Лист Архив, C1", "Архив", "старое")]
    assert by["book.XLSX"][0].warnings == ["Лист «Архив» скрыт и включён в проверку."] and by["book.XLSX"][0].media == documents.MEDIA[".xlsx"]
    # the second sheet and the shared strings are not there: a number stays what it is
    assert [x.text for x in by["lost.xlsx"]] == ["Этап\t0", "один"]


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "large.docx").write_bytes(b"PK\x03\x04" + b"x" * 5000)
    write(tmp_path / "small.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('text')}</w:body></w:document>"})
    monkeypatch.setattr(documents, "MOST_BYTES", 4000)
    found = documents.document_fragments(spark, str(tmp_path))
    by = by_file(found)
    assert (by["large.docx"][0].size, by["large.docx"][0].sha256, by["small.docx"][0].text) == (5004, None, "text") and "1 GiB" in by["large.docx"][0].error
    assert "LessThanOrEqual(length,4000)" in found._jdf.queryExecution().toString().replace(" ", "")


def test_unsafe_archives():
    parts = {"word/document.xml": f"<w:document {W}><w:body>{p('x')}</w:body></w:document>"}
    for more in ({"word/zeros.bin": "0" * 5_000_000}, {"../outside.xml": "x"}, {"/root.xml": "x"}, {"a\\..\\b": "x"}):
        with pytest.raises(tables.UnsafeArchive):
            documents.fragments_of("x.docx", packed(parts | more))
    with pytest.raises(tables.UnsafeArchive, match="MiB"):
        tables.opened(packed(parts), 10)


def test_bounds(monkeypatch, tmp_path):
    write(tmp_path / "x.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('word') * 3}</w:body></w:document>"})
    data = (tmp_path / "x.docx").read_bytes()
    assert len(documents.fragments_of("x.docx", data)[0]) == 3
    for name in ("MOST_FRAGMENTS", "MOST_CHARS", "MOST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(documents, name, 2)
            try:
                documents.fragments_of("x.docx", data)
                raise AssertionError(name)
            except ValueError:
                pass
