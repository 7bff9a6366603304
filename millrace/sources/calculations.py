"""Saved calculations of any version, as the rows that operators.calculation computes on.

Texts are parsed into variants; every field is taken if it has the type that it should have, else it gets its default,
so that files of older versions come in whole: a payment risk of the first version becomes financing over 30 days. What
a strict import refuses is told in `errors` (and nothing else is lost by it): a text that is no object, lists that are
none, values that are unknown. `strictly` raises for them instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What fields may be, their defaults, and how errors name them.
VAT_RATES, AMOUNTS, REGIMES = [0, 5, 7, 10, 11, 20, 22], ["with-vat", "without-vat"], ["vat-payer", "no-vat"]
NO_OBJECT, UNKNOWN = "Файл расчёта не содержит объекта данных.", "Поле «{}» содержит неизвестное значение."
LISTS = {"expenses": "Список дополнительных расходов повреждён.", "subcontractors": "Список соисполнителей повреждён.", "competitors": "Список конкурентов повреждён.", "paymentStages": "График платежей повреждён."}
NEW_EXPENSES = [("Банковская гарантия", 45_000.0), ("Логистика", 30_000.0)]


class Fields:
    """Typed fields of a variant, with the errors that they make."""

    def __init__(self, v: Column):
        self.v, self.errors = v, []

    def _kind(self, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.v, f"$.{name}", "variant"))

    def number(self, name: str, default: Column | float) -> Column:
        value = F.when(self._kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.v, f"$.{name}", "double"))
        return F.coalesce(value, default if isinstance(default, Column) else F.lit(float(default)))

    def string(self, name: str, default: str) -> Column:
        return F.coalesce(F.when(self._kind(name) == "STRING", F.try_variant_get(self.v, f"$.{name}", "string")), F.lit(default))

    def true(self, name: str) -> Column:
        return F.coalesce((self._kind(name) == "BOOLEAN") & F.try_variant_get(self.v, f"$.{name}", "boolean"), F.lit(False))

    def not_false(self, name: str) -> Column:
        return ~F.coalesce((self._kind(name) == "BOOLEAN") & ~F.try_variant_get(self.v, f"$.{name}", "boolean"), F.lit(False))

    def vat(self, name: str, default: float) -> Column:
        rate = self.number(name, -1)
        return F.when(rate.isin(*map(float, VAT_RATES)), rate).otherwise(F.lit(float(default)))

    def choice(self, name: str, allowed: list[str], default: Column | str, label: str) -> Column:
        given = F.when(self._kind(name) == "STRING", F.try_variant_get(self.v, f"$.{name}", "string"))
        none = F.coalesce(self._kind(name), F.lit("VOID")).isin("VOID") | F.coalesce(given == "", F.lit(False))
        known = F.coalesce(given.isin(*allowed), F.lit(False))
        self.errors.append(F.when(~known & ~none, F.lit(UNKNOWN.format(label))))
        return F.when(known, given).otherwise(default if isinstance(default, Column) else F.lit(default))

    def list(self, name: str) -> Column:
        """The entries of a list, null where there is none."""
        return F.when(self._kind(name).startswith("ARRAY"), F.try_variant_get(self.v, f"$.{name}", "array<variant>"))

    def told(self) -> Column:
        return F.array_compact(F.array(*self.errors)) if self.errors else F.array().cast("array<string>")


def _part(f: Fields, amount: Column, vat: Column, amount_type: Column, regime: Column, deductible: Column, included: Column) -> Column:
    return F.struct(amount.alias("amount"), vat.alias("vat_rate"), (amount_type == "with-vat").alias("with_vat"), (regime == "vat-payer").alias("payer"), deductible.alias("deductible"), included.alias("included"))


def _expense(v: Column) -> tuple[Column, Column]:
    f = Fields(v)
    kind, base = f.choice("type", ["fixed", "percent"], "fixed", "тип расхода"), f.choice("percentBase", ["cost", "contract-price", "custom"], "cost", "база расхода")
    price_base = f.choice("percentPriceBase", ["net", "gross"], "net", "формат базы расхода")
    amounts, regime = f.choice("amountType", AMOUNTS, "without-vat", "формат суммы расхода"), f.choice("taxRegime", REGIMES, "no-vat", "налоговый режим расхода")
    row = F.struct(
        f.not_false("enabled").alias("enabled"), kind.alias("kind"), f.number("value", 0).alias("value"), base.alias("base"), price_base.alias("price_base"), f.number("customBase", 0).alias("custom_base"), f.vat("vatRate", 0).alias("vat_rate"),
        (amounts == "with-vat").alias("with_vat"), (regime == "vat-payer").alias("payer"), f.true("inputVatDeductible").alias("deductible"), f.not_false("includeInTotalCost").alias("included"), f.string("name", "Расход").alias("name"),
    )
    return row, f.told()


def _company(v: Column, amount: str, amounts: str, label: str, regime_label: str) -> tuple[Column, Column]:
    f = Fields(v)
    vat = f.vat("vatRate", 0)
    kind = f.choice("amountType", AMOUNTS, amounts, label)
    regime = f.choice("taxRegime", REGIMES, F.when(vat > 0, "vat-payer").otherwise("no-vat"), regime_label)
    return _part(f, f.number(amount, 0), vat, kind, regime, f.true("inputVatDeductible"), f.not_false("includeInTotalCost")), f.told()


def calculations(files: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row a text: the kept columns, name, proposed_price and its type, what operators.calculation needs, competitors
    (as parts with their price in the amount's place), and `errors`."""
    keep = keep or [c for c in files.columns if c != text]
    f = Fields(F.col("_v"))
    read = files.withColumn("_v", F.try_parse_json(F.col(text).cast("string")))
    object_ = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    read = read.withColumn("_object", object_).withColumn("_v", F.when(F.col("_object"), F.col("_v")).otherwise(F.parse_json(F.lit("{}"))))
    for name, said in LISTS.items():
        f.errors.append(F.when(~F.coalesce(f._kind(name), F.lit("VOID")).isin("VOID") & f.list(name).isNull(), F.lit(said)))

    cost_vat = f.vat("costVatRate", 0)
    payer = F.when(cost_vat > 0, "vat-payer").otherwise("no-vat")
    cost = _part(f, f.number("cost", 1_000_000), cost_vat, f.choice("costAmountType", AMOUNTS, "without-vat", "формат себестоимости"), f.choice("costTaxRegime", REGIMES, payer, "налоговый режим себестоимости"), f.true("costInputVatDeductible"), f.not_false("costIncludeInTotalCost"))
    mode, target_type = f.choice("mode", ["margin-to-price", "price-to-margin"], "margin-to-price", "режим расчёта"), f.choice("targetType", ["margin", "markup"], "margin", "целевой показатель")
    price_type = f.choice("priceAmountType", AMOUNTS, "with-vat", "формат цены")
    agent = F.struct(
        f.true("hasAgent").alias("present"), f.choice("agentType", ["fixed", "percent"], "percent", "тип комиссии агента").alias("kind"), f.number("agentValue", 5).alias("value"), f.choice("agentPercentBase", ["net", "gross"], "net", "база комиссии агента").alias("price_base"),
        f.vat("agentVatRate", 0).alias("vat_rate"), (f.choice("agentAmountType", AMOUNTS, "without-vat", "формат комиссии агента") == "with-vat").alias("with_vat"), (f.choice("agentTaxRegime", REGIMES, "no-vat", "налоговый режим агента") == "vat-payer").alias("payer"),
        f.true("agentInputVatDeductible").alias("deductible"), f.not_false("agentIncludeInTotalCost").alias("included"),
    )
    risk, risk_percent = f.true("paymentRiskEnabled"), F.greatest(F.lit(0.0), f.number("paymentRiskPercent", 0))
    stage = lambda v: F.struct(Fields(v).number("sharePercent", 0).alias("share"), Fields(v).number("delayDays", 0).cast("int").alias("delay"))
    financing = F.struct(
        (f.true("financingEnabled") | risk).alias("enabled"), f.number("annualFinancingRate", F.when(risk, risk_percent * 12).otherwise(0.0)).alias("rate"), (f.choice("financingRatePeriod", ["annual", "monthly"], "annual", "период ставки финансирования") == "monthly").alias("monthly"),
        f.number("advancePercent", 0).alias("advance"), f.number("paymentDelayDays", F.when(risk, 30.0).otherwise(0.0)).cast("int").alias("delay"), F.coalesce(F.transform(f.list("paymentStages"), stage), F.array().cast("array<struct<share: double, delay: int>>")).alias("stages"),
        F.when(f.true("factoringEnabled"), f.number("factoringCommissionPercent", 0)).otherwise(0.0).alias("factoring"), (f.number("bidGuaranteeCost", 0) + f.number("performanceGuaranteeCost", 0) + f.number("advanceGuaranteeCost", 0)).alias("guarantees"), f.number("costGrowthReservePercent", 0).alias("reserve"),
    )
    currency = F.struct(f.true("currencyComponentEnabled").alias("enabled"), f.number("foreignAmount", 0).alias("amount"), f.number("exchangeRate", 0).alias("rate"), f.choice("foreignCurrency", ["USD", "EUR", "CNY"], "USD", "валюта").alias("code"))
    basis = f.choice("comparisonBasis", ["gross", "net", "adjusted"], "gross", "методика сравнения")

    default = Fields(F.parse_json(F.lit("{}")))
    new = F.array(*[_expense(F.parse_json(F.lit(f'{{"name": "{n}", "value": {v}}}')))[0] for n, v in NEW_EXPENSES])
    company = {"subcontractors": ("amount", "without-vat", "формат суммы соисполнителя", "налоговый режим соисполнителя"), "competitors": ("price", "with-vat", "формат цены конкурента", "налоговый режим конкурента")}
    entries = {"expenses": F.coalesce(F.transform(f.list("expenses"), lambda v: _expense(v)[0]), new)}
    below = [F.flatten(F.transform(F.coalesce(f.list("expenses"), F.array().cast("array<variant>")), lambda v: _expense(v)[1]))]
    of = lambda how, i: lambda v: _company(v, *how)[i]
    for name, how in company.items():
        none = F.filter(F.array(_company(default.v, *how)[0]), lambda _: F.lit(False))
        entries[name] = F.coalesce(F.transform(f.list(name), of(how, 0)), none)
        below.append(F.flatten(F.transform(F.coalesce(f.list(name), F.array().cast("array<variant>")), of(how, 1))))
    errors = F.when(F.col("_object"), F.concat(f.told(), *below)).otherwise(F.array(F.lit(NO_OBJECT)))
    return read.select(
        *keep, f.string("name", "Новый расчёт").alias("name"), mode.alias("mode"), target_type.alias("target_type"), f.number("targetValue", 20).alias("target"), f.number("proposedPrice", 1_500_000).alias("proposed_price"), (price_type == "with-vat").alias("price_with_vat"),
        f.vat("priceVatRate", 22).alias("price_vat_rate"), cost.alias("cost"), *[c.alias(n) for n, c in entries.items()], agent.alias("agent"), financing.alias("financing"), currency.alias("currency"), basis.alias("basis"),
        f.number("minMargin", 10).alias("min_margin"), f.number("warningMargin", 15).alias("warning_margin"), errors.alias("errors"),
    )


def strictly(found: DataFrame) -> DataFrame:
    """found, of which the first row with an error fails the job."""
    checked = F.when(F.size("errors") > 0, F.raise_error(F.element_at("errors", 1))).otherwise(F.lit(True))
    return found.where(checked).drop("errors")


def read_calculations(spark: SparkSession, path: str) -> DataFrame:
    """The calculations of JSON files, a file each."""
    return calculations(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))
