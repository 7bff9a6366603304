"""XLSX output: round trips, limits of a sheet, and jobs that fail."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.sources.xlsx_sink import XlsxSink, column_name, number


def sheets(path):
    return [s for f in sorted(path.glob("*.xlsx")) for s in tables.xlsx_sheets(f.read_bytes())]


def test_round_trip(spark, tmp_path):
    spark.dataSource.register(XlsxSink)
    data = [("Иван <&> \"И\"", "1 234,50", "x\ny", 1), ("b\x01", "нет", None, 2), ("", "-5", " kept ", 3)]
    df = spark.createDataFrame(data, "`ФИО` string, `Сумма, руб.` string, note string, n int").coalesce(1)
    out = tmp_path / "out"
    df.write.format("millrace_xlsx").option("sheet", "Лист & 1").mode("overwrite").save(str(out))
    (name, hidden, rows), = sheets(out)
    assert (name, hidden) == ("Лист & 1", False)
    assert rows == [["ФИО", "Сумма, руб.", "note", "n"], ['Иван <&> "И"', "1234.50", "x\ny", "1"], ["b", "нет", "", "2"], ["", "-5", "kept", "3"]]
    sheet = zipfile.ZipFile(next(out.glob("*.xlsx"))).read("xl/worksheets/sheet1.xml").decode()
    assert re.findall(r'width="(\d+)"', sheet) == ["14", "13", "12", "12"] and 'ySplit="1"' in sheet and '<c r="B2" s="0"><v>1234.50</v>' in sheet
    found = {r.row_idx: list(r.cells) for r in tables.office_tables(spark, str(out)).collect()}
    assert found[0][0] == "ФИО" and len(found) == 4
    # a second time: the old workbooks go
    df.limit(1).write.format("millrace_xlsx").mode("overwrite").save(str(out))
    assert [len(r) for _, _, r in sheets(out)] == [2] and not [p for p in out.iterdir() if p.name.startswith("_")]
    df.write.format("millrace_xlsx").mode("append").save(str(out))
    assert sorted(len(r) for _, _, r in sheets(out)) == [2, 4]


def test_sheets_and_partitions(spark, tmp_path):
    spark.dataSource.register(XlsxSink)
    spark.range(0, 100, 1, 3).write.format("millrace_xlsx").option("maxRows", "21").mode("overwrite").save(str(tmp_path / "o"))
    found = sheets(tmp_path / "o")
    assert len(found) == 6 and {r[0][0] for _, _, r in found} == {"id"} and max(len(r) for _, _, r in found) == 21
    assert sorted(int(c[0]) for _, _, r in found for c in r[1:]) == list(range(100))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(XlsxSink)
    out = tmp_path / "o"
    df = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        df.write.format("millrace_xlsx").mode("overwrite").save(str(out))
    assert not out.exists() or not list(out.iterdir())


def test_parts():
    assert [number(x) for x in ("1 000,5", "-2", "+.5", "1e3", "abc", "", "1_0", "nan", "1,2,3")] == ["1000.5", "-2", "+.5", "1e3", None, None, None, None, None]
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
