"""Price, tax and rounding functions on columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row, however often it is used: a column that is written out where it
    is used doubles with every step that uses it twice, and inside a lambda nothing is shared."""
    return F.element_at(F.transform(F.array(value), use), 1)


def js_round(value: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(value + 0.5)


def rounded(value: Column, digits: int) -> Column:
    """To the nearest, for values that are kept off the halves: round() of a double writes it out as text for each row."""
    return F.rint(value * 10.0**digits) / 10.0**digits + 0.0


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def net(amount: Column, rate: Column, with_vat: Column) -> Column:
    return F.when(with_vat, amount / (1 + rate / 100)).otherwise(amount)


def gross(amount: Column, rate: Column) -> Column:
    return amount * (1 + rate / 100)


def cost_breakdown(amount: Column, rate: Column, with_vat: Column, payer: Column, deductible: Column, included: Column | None = None) -> Column:
    """Struct of net, gross, VAT paid, VAT that can be deducted, and the cost that remains."""
    a = F.greatest(F.lit(0.0), F.when(F.isnan(amount) | (F.abs(amount) == float("inf")), 0.0).otherwise(F.coalesce(amount, F.lit(0.0))))
    # written out, as a lambda is interpreted for every row; what is shared here is small
    r = F.when(payer, rate).otherwise(0)
    amounts = {"net": net(a, r, with_vat), "gross": F.when(with_vat, a).otherwise(gross(a, r))}
    return _costs(amounts, F.greatest(F.lit(0.0), amounts["gross"] - amounts["net"]), deductible & payer, included)


def _costs(amounts: dict[str, Column], vat: Column, deductible: Column, included: Column | None) -> Column:
    back = F.when(deductible, vat).otherwise(0.0)
    cost = amounts["gross"] - back if included is None else F.when(included, amounts["gross"] - back).otherwise(0.0)
    return F.struct(amounts["net"].alias("net"), amounts["gross"].alias("gross"), vat.alias("input_vat"), back.alias("deductible_vat"), cost.alias("effective_cost"))


def unit_costs(rate: Column, with_vat: Column, payer: Column, deductible: Column, included: Column) -> Column:
    """Struct of the cost that remains of one unit of an amount and the VAT in it that can be deducted: a breakdown is
    in proportion to its amount, if that isn't negative."""
    share = rate / 100
    vat = F.when(payer, F.greatest(F.lit(0.0), F.when(with_vat, share / (1 + share)).otherwise(share))).otherwise(0.0)
    whole = F.when(payer & ~with_vat, 1 + share).otherwise(1.0)
    back = F.when(deductible, vat).otherwise(0.0)
    return F.struct(F.when(included, whole - back).otherwise(0.0).alias("cost"), back.alias("deductible"))


def expense_amount(kind: Column, value: Column, base: Column, enabled: Column) -> Column:
    """A fixed sum, or a percentage of its base."""
    v = F.greatest(F.lit(0.0), value)
    return F.when(~enabled, 0.0).when(kind == "percent", base * v / 100).otherwise(v)


def financing(price: Column, stages: Column, rate: Column, monthly: bool) -> Column:
    """Cost of waiting for payment, over stages of (share, delay) in percent and days."""
    days = 30 if monthly else 365
    zero = F.lit(0.0)
    return F.aggregate(stages, zero, lambda s, x: s + price * F.greatest(zero, x["share"]) / 100 * F.greatest(zero, rate) / 100 * F.greatest(zero, x["delay"]) / days)


def balance(amount: Column, paid: Column) -> Column:
    return F.struct(F.greatest(F.lit(0.0), amount - paid).alias("outstanding"), F.greatest(F.lit(0.0), paid - amount).alias("overpayment"))


def comparable_price(price: Column, rate: Column, how: Column, adjustment: Column) -> Column:
    return F.when(how == "gross", price).when(how == "net", gross(price, rate)).otherwise(price * (1 + adjustment / 100))
