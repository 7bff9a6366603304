"""Import of saved calculations: goldens of the first version, and what strict imports refuse."""

import json

import pytest

from millrace.operators import calculation
from millrace.sources import calculations as C

OLD = {
    "name": "Старый расчёт", "cost": 500_000, "costVatRate": 0, "costAmountType": "without-vat", "subcontractors": [], "paymentRiskEnabled": True, "paymentRiskPercent": 1.3,
    "expenses": [{"id": "e", "name": "Доставка", "category": "Логистика", "type": "fixed", "value": 10_000, "percentBase": "cost", "enabled": True, "comment": ""}],
    "competitors": [{"id": "one", "name": "Конкурент", "price": 1_000_000, "vatRate": 0, "amountType": "without-vat", "taxRegime": "no-vat", "adjustmentPercent": 0}],
}


def read(spark, *texts):
    rows = [(i, t if isinstance(t, str) or t is None else json.dumps(t, ensure_ascii=False)) for i, t in enumerate(texts)]
    return C.calculations(spark.createDataFrame(rows, "i int, content string"))


def test_first_version(spark):
    df = read(spark, OLD)
    (r,) = df.collect()
    assert (r.name, r.errors, len(r.expenses), len(r.competitors), r.competitors[0].amount) == ("Старый расчёт", [], 1, 1, 1_000_000)
    assert r.financing.enabled and (r.financing.rate, r.financing.delay) == (pytest.approx(15.6), 30)
    got = calculation.result_at_price(df, df.proposed_price).collect()[0].result
    assert got.valid and got.own_net == 500_000 and got.additional_costs == 10_000


def test_defaults_and_wrong_types(spark):
    r, s = read(spark, {}, {"cost": "5", "costVatRate": 21, "hasAgent": "yes", "name": 7, "agentIncludeInTotalCost": False, "minMargin": 3}).collect()
    assert (r.cost.amount, len(r.expenses), r.target, r.price_vat_rate, r.agent.value, r.errors) == (1_000_000, 2, 20, 22, 5, [])
    assert (s.cost.amount, s.cost.vat_rate, s.agent.present, s.name, s.agent.included, s.min_margin) == (1_000_000, 0, False, "Новый расчёт", False, 3)


def test_errors(spark):
    rows = read(spark, {"expenses": None, "competitors": "broken"}, {"expenses": [{"type": "odd"}, {"type": ""}], "mode": "mystery"}, "broken {", None, [1], OLD).collect()
    assert [len(r.errors) for r in rows] == [1, 2, 1, 1, 1, 0]
    assert "конкурентов" in rows[0].errors[0] and "неизвестное значение" in rows[1].errors[0] and rows[2].errors == [C.NO_OBJECT]
    assert C.strictly(read(spark, OLD, {})).count() == 2
    with pytest.raises(Exception, match="неизвестное значение"):
        C.strictly(read(spark, OLD, {"mode": "mystery"})).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(OLD, indent=1))
    (tmp_path / "b.json").write_text("nothing")
    assert sorted(len(r.errors) for r in C.read_calculations(spark, str(tmp_path)).collect()) == [0, 1]
