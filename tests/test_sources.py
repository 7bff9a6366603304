import io
import random
import zipfile

from pyspark.sql import functions as F

from millrace.sources import delimited, tables
from millrace.streaming import event_log


def xlsx(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{tables.SHEET[1:-1]}" xmlns:r="{tables.REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{n}" {"state=\'hidden\'" if h else ""} r:id="r{i}"/>' for i, (n, h, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{tables.SHEET[1:-1]}"><si><t>ФИО</t></si></sst>')
        for i, (_, _, rows) in enumerate(sheets):
            cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="s"><v>0</v></c>' if v == "ФИО" else f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
            body = "".join(f"<row>{''.join(cell(r, c, v) for c, v in enumerate(row))}</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{tables.SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def docx(rows):
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{v}</w:t></w:r></w:p></w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{tables.WORD[1:-1]}"><w:body><w:p/><w:tbl>' + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl></w:body></w:document>")
    return out.getvalue()


BOOK = [("other", False, [["a", "b"], ["1", "2"]]), ("people", True, [["title"], ["ФИО", "", "Роль"], ["Иван", "", "Инженер"]]), ("contracts", False, [["Номер", "Заказчик"], ["1", "X"]])]


def test_office_tables(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(xlsx(BOOK))
    (tmp_path / "d.docx").write_bytes(docx([["h1", "h2"], ["", ""], ["x", "y"]]))
    assert [s[:2] for s in tables.xlsx_sheets((tmp_path / "b.xlsx").read_bytes())] == [("other", False), ("people", True), ("contracts", False)]
    found = sorted((r.file.rsplit("/", 1)[-1], r.row_idx, list(r.cells)) for r in tables.office_tables(spark, str(tmp_path)).collect())
    want = [("b.xlsx", 0, ["ФИО", "", "Роль"]), ("b.xlsx", 1, ["Иван", "", "Инженер"]), ("d.docx", 0, ["h1", "h2"]), ("d.docx", 1, ["x", "y"])]
    assert found == want


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a;b", "+1+1"), ('say "x"', "line\nbreak"), (None, " plain ")], "one string, two string").coalesce(1)
    tables.write_csv(df, path)
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith("﻿one;two\r\n".encode()) and b"'+1+1" in raw
    got = [list(r.cells) for r in tables.read_csv(spark, path).orderBy("row_idx").collect()]
    assert got == [["one", "two"], ["a;b", "'+1+1"], ['say "x"', "line\nbreak"], ["", "plain"]]
    (tmp_path / "c.csv").write_text("a,b\n,\n1, 2 \n")
    assert [list(r.cells) for r in tables.read_csv(spark, str(tmp_path / "c.csv")).orderBy("row_idx").collect()] == [["a", "b"], ["1", "2"]]


def plain_csv(source):
    """Character by character."""
    source = source.removeprefix("\ufeff")
    first = source.replace("\r\n", "\n").split("\n")[0]
    sep = delimited.sniff_delimiter(first)
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(source):
        ch = source[i]
        if ch == '"' and quoted and source[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            row, cell = [*row, cell], ""
        elif ch in "\r\n" and not quoted:
            i += ch == "\r" and source[i + 1 : i + 2] == "\n"
            rows.append([*row, cell])
            row, cell = [], ""
        else:
            cell += ch
        i += 1
    rows = [[c.strip(delimited.BLANKS) for c in r] for r in [*rows, [*row, cell]]]
    return [r for r in rows if any(r)]


def read_all(spark, path):
    by = {}
    for r in delimited.read_csv(spark, str(path)).orderBy("file", "row_idx").collect():
        own = by.setdefault(r.file.rsplit("/", 1)[1], [])
        assert r.row_idx == len(own)
        own.append(list(r.cells))
    return by


def test_csv_in_splits(spark, tmp_path):
    """Quoted cells with line feeds, over the cuts of small splits; each file has its own delimiter."""
    rng = random.Random(11)
    texts = {}
    for i in range(6):
        pieces = ["a", "bc", " ", ";", ",", '"', '""', "\n", "\r\n", "\r", "é", '"x\n\ny;z"', '"1,2"', "long text ", '"' + "q\n" * 60 + '"']
        texts[f"f{i}.csv"] = ("\ufeff" if i % 2 else "") + "".join(rng.choices(pieces, k=rng.choice([0, 3, 400, 900])))
    texts["open.csv"] = 'a;b\n1;"never\nclosed\n' + "x;y\n" * 100
    texts["plain.csv"] = "".join(f"{i},{i * i}\n" for i in range(500))
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    keys = {"spark.sql.files.maxPartitionBytes": "128", "spark.sql.files.openCostInBytes": "16"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = delimited._lines(spark, str(tmp_path))
        assert lines.select("file", "start").distinct().count() > 40
        found = read_all(spark, tmp_path)
    finally:
        for k in keys:
            spark.conf.unset(k)
    for name, text in texts.items():
        assert found.get(name, []) == plain_csv(text), name


def test_csv_states_by_shuffle(spark, tmp_path, monkeypatch):
    text = 'k;v\n' + "".join(f'{i};"line {i}\nmore"\n' for i in range(300))
    (tmp_path / "a.csv").write_text(text)
    monkeypatch.setattr(delimited, "MOST_BROADCAST", 0)
    assert read_all(spark, tmp_path)["a.csv"] == plain_csv(text)


def test_event_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    data = [(1, "2026-01-01 10:00:00", "a", 1.0), (2, "2026-01-01 11:00:00", "a", 2.0), (3, "2026-01-02 09:00:00", "b", 5.0), (4, "2026-01-04 00:00:00", "b", 7.0)]
    spark.createDataFrame(data, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t").select("event_id", "ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "log"))
    counts = event_log.counts_by_window(event_log.read_events(spark, str(tmp_path / "log"), schema))
    query = counts.writeStream.outputMode("append").format("memory").queryName("log_counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((str(r.start)[:10], r.event_type, r.n, r.total) for r in spark.table("log_counts").collect())
    assert got == [("2026-01-01", "a", 2, 3.0), ("2026-01-02", "b", 1, 5.0)]
