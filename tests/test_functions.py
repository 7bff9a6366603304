"""Goldens of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, money, pages, text


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def of(*columns):
        row = one.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        out = [x.asDict() if hasattr(x, "asDict") else x for x in row]
        return out[0] if len(out) == 1 else out

    return of


def day(x):
    return F.lit(x).cast("date")


def test_names(value):
    assert value(*[text.company_name(F.lit(x)) for x in ("  ООО «Ёлка—Плюс»  ", "ACME, Inc.", None, "a b")]) == ["ооо елка плюс", "acme inc ", "", "a b"]
    assert value(*[text.company_name_strict(F.lit(x)) for x in ("ООО «Ёлка—Плюс»", "ACME, Inc.", None)]) == ["ооо елка плюс", "acme inc", ""]
    assert value(text.digits(F.lit("ИНН 77-01"))) == "7701"
    assert value(*[text.valid_inn(F.lit(x)) for x in ("", "7701234567", "770123456", "770123456789", None)], text.valid_inn(F.lit("bad"), F.lit("bad"))) == [True, True, False, True, True, True]


def test_tokenizers(value):
    assert value(text.contract_keywords(F.lit("Оказание услуг: Аудит IT-систем, аудит и НК"))) == ["аудит", "it-систем", "аудит"]
    assert value(text.staff_keywords(F.lit("Согласно плану аудит аудит"))) == ["согласно", "плану", "аудит"]
    assert value(text.tokens(F.lit("Это Тестовый тестовый текст, 2024 abc"))) == ["тестовый", "текст", "2024"]
    assert value(text.contained(F.array(F.lit("ауд"), F.lit("ауд"), F.lit("нет")), F.lit("аудит"))) == ["ауд"]


def test_parsers(value):
    cases = {"/ 72 000\n/ с 04.05.2026": 72000.0, "1 234,5 руб": 1234.5, "нет": 0.0, None: 0.0, "12.75": 12.75}
    assert value(*[text.number(F.lit(x)) for x in cases]) == list(cases.values())
    cases = {"7": 7.0, "5,5": 5.5, "около 12 лет": 12.0, "": 0.0, None: 0.0}
    assert value(*[text.years(F.lit(x)) for x in cases]) == list(cases.values())
    assert value(text.email(F.lit("тел. +7 (912) 345-67-89, a.b@mail.ru")), text.phone(F.lit("тел. +7 (912) 345-67-89, a.b@mail.ru"))) == ["a.b@mail.ru", "+7 (912) 345-67-89"]
    assert value(text.entries(F.lit("один; два\r\n не указано ;;три"))) == ["один", "два", "три"]
    assert value(*[text.is_yes(F.lit(x)) for x in ("Да", "YES", "1", "нет", None)]) == [True, True, True, False, False]
    assert value(*[text.travel_ready(F.lit(x)) for x in ("готов", "не готов", "Да, любые", "нет", "", "командировок нет", "без командировок")]) == [True, False, True, False, False, False, False]


def test_text_output(value):
    assert value(text.csv_cell(F.lit("+1+1")), text.csv_cell(F.lit('a"b;c')), text.csv_cell(F.lit(" =x")), text.csv_cell(F.lit(None).cast("string"))) == ["'+1+1", '"a""b;c"', "' =x", ""]
    assert value(text.escape_html(F.lit("<a href='x'>\"&"))) == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;"
    keys = [value(text.natural_key(F.lit(x))) for x in ("Договор 2", "Договор 10", "договор 02", None)]
    assert keys[0] < keys[1] and keys[0] == keys[2] and keys[3] == ""
    assert value(text.summary([F.lit("a"), F.lit(" "), F.lit("b")], F.lit("old")), text.summary([F.lit("")], F.lit("old"))) == ["a · b", "old"]
    assert value(text.tone(F.lit("x"), {"x": "good"}), text.tone(F.lit("y"), {"x": "good"})) == ["good", "neutral"]


def test_business_days(value):
    d = dt.date
    assert value(dates.business_days(day("2026-08-28"), day("2026-09-01"))) == [d(2026, 8, 28), d(2026, 8, 31), d(2026, 9, 1)]
    assert value(dates.business_days(day("2026-09-01"), day("2026-08-28"))) == [] and value(dates.business_days(day(None), day("2026-08-28"))) == []


def test_number_of_business_days_equals_their_list(spark):
    spans = spark.range(0, 14).crossJoin(spark.range(-3, 40).withColumnRenamed("id", "n"))
    start = F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int"))
    end = F.date_add(start, F.col("n").cast("int"))
    assert spans.where(F.size(dates.business_days(start, end)) != dates.n_business_days(start, end)).count() == 0


def test_day_counts_and_expiry(value):
    today = day("2026-03-10")
    assert value(*[dates.days_to(F.date_add(today, k), today) for k in (-2, -1, 0, 7)]) == [-2, -1, 0, 7]
    assert value(*[dates.days_until(F.date_add(today, k), today) for k in (-2, -1, 0, 1, 7)]) == [-1, 0, 1, 2, 8]
    cases = [(True, None), (False, None), (False, "2026-03-09"), (False, "2026-03-10"), (False, "2026-05-08"), (False, "2026-05-09")]
    assert value(*[dates.expiry(F.lit(u), day(e), today, 60) for u, e in cases]) == ["unlimited", "missing", "expired", "expiring", "expiring", "valid"]


def test_dates_of_text(value):
    cases = {"2026-04-24": "2026-04-24", "от 24.04.2026 г.": "2026-04-24", "Апрель 2026": "2026-04-01", "н.в.": "", None: ""}
    assert value(*[dates.any_date(F.lit(x)) for x in cases]) == list(cases.values())
    cases = {"до 2030": "2030-12-31", "до2027г": "2027-12-31", "31.12.2028": "2028-12-31", "2029-01-02": "2029-01-02", "a2030": "", "": ""}
    assert [value(dates.certificate_validity(F.lit(x)))["expires"] for x in cases] == list(cases.values())
    assert value(dates.certificate_validity(F.lit("Бессрочно"))) == {"unlimited": True, "expires": ""}
    grid = value(dates.month_grid(day("2026-03-01")))
    assert len(grid) == 42 and grid[0] == dt.date(2026, 2, 23)


def test_documents_valid(spark):
    kind = "docs array<struct<category string, unlimited boolean, expires date>>"
    rows = [([],), ([("education", False, None)],), ([("permit", False, None)],), ([("certificate", True, None)],), ([("certificate", False, dt.date(2026, 3, 9))],), ([("contract", False, dt.date(2026, 3, 10)), ("education", None, None)],)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(dates.documents_valid(F.col("docs"), day("2026-03-10"))).collect()]
    assert got == [False, True, False, True, False, True]


def test_money(value):
    cost = lambda a, deductible, payer=True, with_vat=True: value(money.cost_breakdown(F.lit(a), F.lit(22), F.lit(with_vat), F.lit(payer), F.lit(deductible)))
    assert cost(122.0, True)["effective_cost"] == pytest.approx(100) and cost(122.0, False)["effective_cost"] == pytest.approx(122)
    assert cost(100.0, True, payer=False)["gross"] == 100 and cost(-5.0, True)["effective_cost"] == 0 and cost(float("nan"), True)["net"] == 0
    assert value(money.js_round(F.lit(-2.5)), money.js_round(F.lit(2.5))) == [-2, 3]
    assert value(money.balance(F.lit(100.0), F.lit(120.0))) == {"outstanding": 0.0, "overpayment": 20.0}
    stages = F.array(F.struct(F.lit(100.0).alias("share"), F.lit(30.0).alias("delay")))
    assert value(money.financing(F.lit(1_000_000.0), stages, F.lit(1.3), monthly=True)) == pytest.approx(13_000)


def test_page_ranges(value):
    of = lambda s, n=9, **k: value(pages.page_ranges(F.lit(s), F.lit(n), **k))
    assert of("1-3, 5") == {"pages": [0, 1, 2, 4], "error": None} and of("3,1") == {"pages": [2, 0], "error": None}
    assert of("1-3,2")["error"] == "repeated" and of("3-1")["error"] == "out-of-range" and of("9-10")["error"] == "out-of-range" and of("x")["error"] == "unreadable" and of(None)["error"] == "unreadable"
    assert of("5, 1-3, 2", distinct=True) == {"pages": [0, 1, 2, 4], "error": None}
    assert value(pages.reorder(F.array(*map(F.lit, "abc")), F.array(F.lit(2), F.lit(0)))) == ["c", "a"]
