"""Calculations with lists longer than what is compiled, and without lambdas for the entries that are."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import money
from millrace.operators import calculation
from tests.test_rules import calculation_row


def rows(spark, n):
    flags = "'with_vat', false, 'payer', false, 'deductible', false, 'included', true"
    listed = lambda of: f"transform(sequence(1, {n}), i -> {of})"
    return calculation_row(
        spark,
        expenses=listed(f"named_struct('enabled', i % 5 <> 0, 'kind', 'fixed', 'value', CAST(i AS double), 'base', 'direct-cost', 'price_base', 'net', 'custom_base', 0.0D, 'vat_rate', 0.0D, {flags})"),
        subcontractors=listed(f"named_struct('amount', 10.0D * i, 'vat_rate', 0.0D, {flags})"),
        financing=f"named_struct('enabled', true, 'rate', 36.5D, 'monthly', false, 'advance', 0.0D, 'delay', 0, 'stages', {listed(f'named_struct("share", 100.0D / {n}, "delay", i)')}, 'factoring', 0.0D, 'guarantees', 0.0D, 'reserve', 0.0D)",
    )


@pytest.mark.parametrize("n", [1, 4, 5, 12])
def test_lists_of_any_length_are_summed_whole(spark, n):
    got = calculation.result_at_price(rows(spark, n), F.lit(1000.0)).first().result
    assert got.additional_costs == sum(i for i in range(1, n + 1) if i % 5) and got.subcontractors_net == 10 * n * (n + 1) / 2
    assert got.financing_cost == pytest.approx(1000 * 0.365 / 365 * (n + 1) / 2) and got.valid


def test_entries_are_compiled(spark):
    plan = calculation.result_at_price(rows(spark, 3), F.lit(1000.0)).select("result.profit")._jdf.queryExecution().analyzed().toString()
    made = rows(spark, 3)._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(") <= made.count("transform(")


def test_rounded(spark):
    values = [1.23454, -0.00001, -2.71828, float("inf"), 123456789.12344]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(money.rounded(F.col("v"), 4).alias("a"), F.round("v", 4).alias("b"))
    assert [str(r.a) for r in df.collect()] == [str(r.b) for r in df.collect()]
