import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, pages, text
from millrace.operators import calculation, imports, pricing, records, rules



def today():
    return F.lit(dt.date(2026, 5, 10))


def one(spark, **columns):
    return spark.range(1).select(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def value(df, column):
    return df.select(column.alias("v")).first().v


def test_contract_checks(spark):
    row = one(
        spark, start_date="DATE '2026-05-02'", end_date="DATE '2026-05-01'", amount="100.0D", paid_amount="120.0D", payment_status="'Полностью оплачено'", payment_planned="CAST(NULL AS DATE)", payment_actual="CAST(NULL AS DATE)",
        acts_status="'Подписаны полностью'", stage="'Подготовка'",
    )
    assert [c.code for c in value(row, rules.contract_checks())] == ["date-order", "overpayment", "acts-preparation"]


def test_procurement_warnings_and_completeness(spark):
    row = one(
        spark, name="' '", customer="'c'", subject="'s'", nmc="0.0D", question_deadline="DATE '2026-05-12'", submission_deadline="DATE '2026-05-09'", status="'Новая'",
        partners="array(named_struct('work_share', 60.0D), named_struct('work_share', 50.5D))", scenarios="array(named_struct('name', 'Сам', 'vat_rate', 120.0D), named_struct('name', '', 'vat_rate', 22.0D))",
    )
    got = value(row, rules.procurement_warnings(today()))
    assert len(got) == 6 and got[3] == "Суммарная доля партнёров 110.5% превышает 100%." and got[4] == "Ставка НДС сценария «Сам» должна быть от 0 до 100%."
    row = one(
        spark, checklist="array(named_struct('text', 'КП', 'mandatory', true, 'done', false, 'file_version', '', 'validation', ''), named_struct('text', '', 'mandatory', false, 'done', true, 'file_version', '', 'validation', ''))",
        requirements="array(named_struct('text', 'r', 'status', 'Требует уточнения', 'question', ' ', 'evidence', array(named_struct('stale', true), named_struct('stale', true))))",
    )
    got = value(row, rules.application_completeness())
    assert (got.ready, got.missing, got.invalid_files, got.stale_evidence) == (False, ["КП"], ["Пункт заявки"], ["r", "r"])
    got = value(row, rules.compliance())
    assert (got.confirmed, got.total, got.gaps, got.questions) == (0, 1, ["r"], ["r"])


def test_schedule_risks_come_once(spark):
    row = one(
        spark, internal_deadline="CAST(NULL AS DATE)", submission_deadline="DATE '2026-05-12'", status="'Новая'", estimated_hours="40.0D",
        assignments="array(named_struct('role', 'Эксперт', 'planned_hours', 10.0D, 'overload', 'x'), named_struct('role', 'Эксперт', 'planned_hours', 10.0D, 'overload', 'x'))",
    )
    assert value(row, rules.schedule_risks(today())) == ["До внутреннего срока 2 дн.", "Не назначен менеджер", "Не распределено 20 ч.", "Перегрузка сотрудника: x"]


def test_staff_readiness_and_documents(spark):
    doc = "named_struct('category', '{}', 'name', 'n', 'type', '', 'unlimited', {}, 'expires', {})".format
    docs = f"array({doc('education', 'true', 'CAST(NULL AS DATE)')}, {doc('contract', 'false', chr(68) + 'ATE ' + repr('2026-05-09'))}, {doc('certificate', 'false', 'DATE ' + repr('2026-06-01'))})"
    row = one(spark, full_name="'a'", role="'r'", grade="''", skills="array('x')", basis="'Иное'", basis_other="' '", start_date="DATE '2020-01-01'", qualification="'q'", documents=docs)
    got = value(row, rules.staff_readiness(today()))
    assert (got.met, got.total, got.missing, got.ready) == (7, 10, ["Грейд", "Основание сотрудничества", "Документ-основание"], False)
    assert value(row.withColumn("basis", F.lit("Штат")), rules.staff_readiness(today())).total == 9
    urgent = value(row, rules.urgent_document("documents", today(), 60))
    assert (urgent.at, urgent.category) == (1, "expired")
    assert [value(row, rules.any_expiry("documents", c, today(), 60)) for c in ("expired", "unlimited", "no-document")] == [True, True, False]


@pytest.mark.parametrize("email,stored,want", [("", None, "ok"), ("name@example.com", None, "ok"), ("a b@c", None, "error"), ("a@b..c", None, "error"), ("bad", "bad", "warning"), ("bad", "worse", "error")])
def test_email(spark, email, stored, want):
    assert value(one(spark, e=F.lit(email), s=F.lit(stored)), rules.email_state(F.col("e"), F.col("s"))) == want


def test_jobs_budget_and_small_sums(spark):
    row = one(spark, s="'running'", done="'completed'")
    assert value(row, rules.next_job_status(F.col("s"), False)) == "interrupted" and value(row, rules.next_job_status(F.col("s"), True)) == "cancelled"
    with pytest.raises(Exception, match="cannot be cancelled"):
        value(row, rules.next_job_status(F.col("done"), True))
    n = lambda x: F.lit(float(x))
    assert value(row, rules.render_budget(F.lit(5001), n(595), n(842), n(300), F.lit(10))) == ["pages"] and value(row, rules.render_budget(F.lit(1), n(5000), n(5000), n(600), F.lit(0))) == ["size", "pixels"]
    assert value(row, rules.savings_percent(F.lit(240), F.lit(161))) == pytest.approx(32.9166, abs=1e-3) and value(row, rules.complexity(F.lit("Высокая"))) == (3, 80, 4)
    words = "array(named_struct('text', 'a', 'confidence', 10.0D), named_struct('text', 'b', 'confidence', 40.0D), named_struct('text', 'c', 'confidence', 80.0D))"
    assert value(one(spark, w=words), rules.word_confidence("w")) == (60.0, ["b"])


def calculation_row(spark, **more):
    none = "named_struct('amount', 0.0D, 'vat_rate', 0.0D, 'with_vat', false, 'payer', false, 'deductible', false, 'included', true)"
    columns = {
        "proposed_price": "1000000.0D", "cost": none, "subcontractors": f"filter(array({none}), x -> false)", "expenses": "CAST(array() AS array<struct<enabled:boolean,kind:string,value:double,base:string,price_base:string,custom_base:double,vat_rate:double,with_vat:boolean,payer:boolean,deductible:boolean,included:boolean>>)",
        "agent": "named_struct('present', false, 'kind', 'fixed', 'value', 0.0D, 'price_base', 'net', 'vat_rate', 0.0D, 'with_vat', false, 'payer', false, 'deductible', false, 'included', true)",
        "financing": "named_struct('enabled', true, 'rate', 1.3D, 'monthly', true, 'advance', 0.0D, 'delay', 30, 'stages', CAST(array() AS array<struct<share:double,delay:int>>), 'factoring', 0.0D, 'guarantees', 0.0D, 'reserve', 0.0D)",
        "currency": "named_struct('enabled', false, 'amount', 0.0D, 'rate', 0.0D)", "price_vat_rate": "0.0D", "min_margin": "5.0D", "warning_margin": "15.0D", "target": "10.0D",
    } | more
    return one(spark, **columns)


def test_financing_is_part_of_the_costs(spark):
    got = calculation.result_at_price(calculation_row(spark), F.col("proposed_price")).first().result
    assert (got.financing_cost, got.profit, got.status, got.valid) == (pytest.approx(13_000), pytest.approx(987_000), "success", True)
    got = calculation.result_at_price(calculation_row(spark), F.lit(0.0)).first().result
    assert (got.profit, got.margin, got.markup) == (0.0, 0.0, 0.0)


def test_issues_and_scenarios(spark):
    bad = calculation_row(spark, warning_margin="1.0D", target="CAST('NaN' AS double)", currency="named_struct('enabled', true, 'amount', 1.0D, 'rate', 0.0D)", cost="named_struct('amount', -1.0D, 'vat_rate', 0.0D, 'with_vat', false, 'payer', false, 'deductible', false, 'included', true)")
    assert [i.field for i in value(bad, calculation.calculation_issues())] == ["cost", "warningMargin", "targetValue", "exchangeRate"]
    rows = calculation.price_scenarios(calculation_row(spark), F.col("proposed_price")).orderBy("step").collect()
    assert len(rows) == 9 and rows[0].result.price_net == pytest.approx(800_000) and rows[8].result.financing_cost == pytest.approx(15_600)  # it follows the price


def test_strict_scenario(spark):
    n = lambda x: F.lit(float(x))
    got = value(spark.range(1), pricing.scenario_financials(n(122), n(22), n(75), n(0), n(100), strict=True))
    assert (got.net, got.vat, got.profit, got.headroom) == (pytest.approx(100), pytest.approx(22), pytest.approx(25), 22)
    with pytest.raises(Exception, match="VAT rate"):
        value(spark.range(1), pricing.scenario_financials(n(122), n(122), n(75), n(0), n(100), strict=True))


def test_records(spark):
    rows = spark.createDataFrame([("1", "m", "application", '{"historyLimit": 5000}', False, 3), ("2", "m", "b", "{}", True, 2), ("3", "n", "c", "{}", False, 1), ("4", "m", "a", "{}", None, 1)], "id string, module string, title string, payload string, archived boolean, updated_at int")
    assert [r.id for r in records.list_records(rows, "m").collect()] == ["1", "4"] and records.list_records(rows, "m", True).count() == 3
    assert records.lookup(rows, module="m", id="2").count() == 1 and records.history_limit(rows).first()[0] == 1000 and records.history_limit(rows.where("id = '2'")).first()[0] == 100
    assert [r.id for r in records.newest(rows, ["updated_at"], 2, module="m").collect()] == ["1", "2"] and records.prioritised(rows, F.col("title") == "c", "updated_at").first().id == "3"
    files = spark.createDataFrame([("1", "p"), ("1", " "), ("2", "q"), ("4", "p"), ("4", "r")], "id string, path string")
    kept, paths = records.registry_archive(rows, None, files, spark.createDataFrame([("p",)], "path string"))
    assert [r.title for r in kept.collect()] == ["a", "application", "c"] and [r.path for r in paths.collect()] == ["p"]
    shot = records.snapshots(spark.createDataFrame([("1",)], "source_id string"), rows, today()).first().snapshot
    assert shot.title == "application" and shot.captured_at == dt.date(2026, 5, 10)
    spec = "array(named_struct('name', 'a', 'is_primary', false), named_struct('name', 'b', 'is_primary', true))"
    assert value(one(spark, a=spec), records.primary_assignment("a", F.expr("named_struct('name', 'z', 'is_primary', true)"))).name == "b"


def test_import_documents_are_replaced_as_groups(spark):
    docs = lambda *kinds: "array(" + ", ".join(f"named_struct('category', '{k[0]}', 'name', '{k[1]}')" for k in kinds) + ")"
    row = one(spark, old=docs(("certificate", "c1"), ("education", "e1"), ("other", "o1")), new=docs(("certificate", "c2"), ("education", "e2")))
    got = value(row, imports.merged_documents(F.col("old"), F.col("new"), {"certificates": 3}))
    assert [d.name for d in got] == ["e1", "o1", "c2"]
    assert value(row, imports.missing_fields({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)})) == ["a", "c"]


def test_names_hash_and_geometry(spark):
    row = spark.range(1)
    assert value(row, text.safe_file_name(F.lit("Акт №1/2"))) == "Акт _1_2" and value(row, text.safe_file_name(F.lit(" "))) == "закупка"
    assert value(row, text.block_name(F.lit(' Смета: "А"/1 .. .pdf'))) == "Смета А 1" and value(row, text.rubles(F.lit(1234567.5))) == "1 234 568 ₽"

    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return f"{h:x}"

    for s in ("", "default", "//server/share-a", "Папка"):
        assert value(row, text.fnv1a(F.lit(s))) == fnv(s)
    period = lambda v: value(row, dates.period_end(F.lit(v)))
    assert tuple(period("н.в.")) == (None, True) and tuple(period("декабрь 2025")) == (dt.date(2025, 12, 1), False)
    due = lambda h: value(row, dates.backup_due(F.expr("TIMESTAMP '2026-01-01 00:00:00'"), F.expr("TIMESTAMP '2026-01-01 05:00:00'"), F.lit(h)))
    assert [due(h) for h in (0, 5, 6)] == [False, True, False]
    rect = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"))])
    assert tuple(value(row, pages.placed_rect(rect(2, -1, 5, 0)))) == pytest.approx((0.99, 0, 0.01, 0.01))
    assert tuple(value(row, pages.moved_rect(rect(0.5, 0.5, 0.25, 0.25), F.lit(0.5), F.lit(-0.6)))) == pytest.approx((0.75, 0, 0.25, 0.25))
    assert tuple(value(row, pages.rotated_size(F.lit(2.0), F.lit(1.0), F.lit(90.0)))) == pytest.approx((1, 2))


def test_labelled_leaves(spark):
    from millrace.operators import history

    rows = spark.createDataFrame([("1", '{"name": "", "documents": [{"id": 7, "basis": true}, {"basis": "x"}], "updatedAt": "t"}')], "id string, p string")
    got = history.labelled(history.flatten_json(rows, "id", "p"), {"name": "Название", "documents": "Документы"}).collect()
    assert sorted((r.field, r.value) for r in got) == [("Документы / № 1 / basis", "Да"), ("Документы / № 2 / basis", "x"), ("Название", "—")]


def test_patches_of_lists(spark):
    """Lists and nulls come back; a field that is set twice has its last value."""
    ddl = "row int, name string, skills array<string>, hours double"
    base = spark.createDataFrame([(1, "a", ["x"], 1.5), (2, "b", [], None), (3, "c", None, 2.0)], ddl)
    edited = spark.createDataFrame([(1, "a", ["x", "y z"], None), (2, 'b "q"', ["k"], 3.0), (3, "c", None, 2.0)], ddl)
    found = imports.patches(base, edited)
    assert sorted((r.row, r.field) for r in found.collect()) == [(1, "hours"), (1, "skills"), (2, "hours"), (2, "name"), (2, "skills")]
    assert sorted(map(str, imports.patched(base, found).collect())) == sorted(map(str, edited.collect()))
    twice = spark.createDataFrame([(1, "name", '"first"', 1), (1, "name", '"last"', 2), (9, "name", '"x"', 1)], "row int, field string, value string, at int")
    assert [r.name for r in imports.patched(base, twice, order="at").orderBy("row").collect()] == ["last", "b", "c"]


def test_assignment_patches(spark):
    kind = "array<struct<id: string, position: string, rate: double>>"
    rows = [(1, [("i", "p", 1.0), ("j", "q", 2.0)], [("n1", "p2", 1.0), ("n2", "q", None)]), (2, [("i", "p", 1.0)], [("i", "p", 1.0), ("k", "r", 3.0)]), (3, [("i", "p", 1.0)], [("z", "p", 1.0)])]
    df = spark.createDataFrame(rows, f"row int, before {kind}, after {kind}")
    told = df.withColumn("o", imports.assignment_patches(F.col("before"), F.col("after"), ["position", "rate"]))
    by = {r.row: r for r in told.collect()}
    assert by[1].o.patches == [{"position": '"p2"'}, {"rate": "null"}] and by[1].o.replacement is None and len(by[2].o.replacement) == 2 and by[3].o.patches == [{}]
    got = told.select("row", imports.with_assignments(F.col("before"), F.col("o"), df.schema["before"].dataType.elementType).alias("x"))
    assert {r.row: [tuple(x) for x in r.x] for r in got.collect()} == {1: [("i", "p2", 1.0), ("j", "q", None)], 2: [("i", "p", 1.0), ("k", "r", 3.0)], 3: [("i", "p", 1.0)]}


def test_reports(spark):
    from millrace.operators import reports

    kinds = "name string, partners array<struct<name: string, role: string, work_share: double, responsibility: string>>, requirements array<struct<text: string, evidence_kind: string, evidence: string, status: string, question: string>>, checklist array<struct<text: string, done: boolean, responsible: string>>"
    rows = [("A & B", [("x <1>", "r", 60.5, None), ("y", "r", 50.0, "z")], [("t1", "k", "e", "Подтверждено", ""), ("t2", "k", None, "Требует уточнения", ""), ("t3", "k", "e", "Нет", "why?")], [("c", True, "p"), ("d", None, None)]), ("C", [], [], [])]
    df = spark.createDataFrame(rows, kinds)
    made = df.select(reports.work_allocation(F.col("partners")).alias("w"), reports.summary(F.col("name"), F.lit("2026-01-01"), F.lit(None).cast("string"), F.col("requirements"), F.col("checklist")).alias("s"), reports.document(F.lit("T"), F.col("name"), F.lit("c"), F.lit("s"), F.lit(1234567.5), F.lit("<b/>")).alias("d")).collect()
    assert "<td>x &lt;1&gt;</td><td>r</td><td>60.5</td><td></td>" in made[0].w and "<b>110.5%</b>" in made[0].w and "warn" in made[0].w
    assert 'colspan="4"' in made[1].w and "<b>0%</b>" in made[1].w and "warn" not in made[1].w
    assert made[0].s.endswith('<ul><li class="warn">t2: Требует уточнения</li><li class="warn">t3: Нет</li><li>t2</li><li>why?</li></ul>') and "<li>☑ c — p</li><li>☐ d — </li>" in made[0].s
    assert "A &amp; B" in made[0].d and "1\u00a0234\u00a0568\u00a0₽" in made[0].d and made[0].d.endswith("<b/></html>")
