"""The whole calculation at a price: costs that follow the price, financing, taxes, profit and status.

A calculation is a row. Cost parts are structs (amount, vat_rate, with_vat, payer, deductible, included): `cost`,
the entries of `subcontractors` and, with a value in the amount's place, `expenses` and `agent`:
  expenses: array of (enabled, kind, value, base, price_base, custom_base, vat_rate, with_vat, payer, deductible, included)
  agent: (present, kind, value, price_base, vat_rate, with_vat, payer, deductible, included)
  financing: (enabled, rate, monthly, advance, delay, stages (share, delay), factoring, guarantees, reserve)
  currency: (enabled, amount, rate); price_vat_rate, min_margin, warning_margin, target.
Missing numbers count as zero, missing flags as false. All of it is narrow: a price and a row give a result. Costs that
follow the price do so in a straight line, so each calculation is reduced to a few coefficients first, once for however
many prices are asked for; at a price there is only arithmetic left, without lambdas. A lambda is interpreted for every
element, so the first UNROLLED entries of a list are written out, and only those of longer lists are left to one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import cost_breakdown, unit_costs

EPSILON = 1e-9
#: Entries of a list that are compiled; the others are summed by a lambda.
UNROLLED = 4


def _zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0)))


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _breakdown(part: Column, amount: Column, included: Column | None = None) -> Column:
    counted = _flag(part["included"]) if included is None else included
    return cost_breakdown(amount, F.coalesce(part["vat_rate"].cast("double"), F.lit(0.0)), _flag(part["with_vat"]), _flag(part["payer"]), _flag(part["deductible"]), counted)


def _with_sums(df: DataFrame, name: str, parts: Column, of) -> DataFrame:
    """df with `{name}_{field}`, the sum over all parts, in their order, of each field of of(part)."""
    first = [of(F.get(parts, i)) for i in range(UNROLLED)]
    more = F.slice(parts, UNROLLED + 1, F.greatest(F.size(parts) - UNROLLED, F.lit(0)))
    found = {}
    for field in first[0]:
        total = reduce(lambda s, i: s + F.when(F.size(parts) > i, first[i][field]).otherwise(0.0), range(UNROLLED), F.lit(0.0))  # noqa: B023
        # in one projection with the lambda, which Spark compiles to methods of a size that the JVM compiles further
        found[f"{name}_{field}"] = F.when(F.size(parts) > UNROLLED, F.aggregate(more, total, lambda s, p: s + of(p)[field])).otherwise(total)  # noqa: B023
    return df.withColumns(found)


def _unit(part: Column, included: Column) -> Column:
    return unit_costs(F.coalesce(part["vat_rate"].cast("double"), F.lit(0.0)), _flag(part["with_vat"]), _flag(part["payer"]), _flag(part["deductible"]), included)


def _line(fixed: Column, slope: Column, unit: Column) -> dict[str, Column]:
    """Cost and deductible VAT of an amount of fixed + slope * net price."""
    return {"fixed": fixed * unit["cost"], "slope": slope * unit["cost"], "fixed_vat": fixed * unit["deductible"], "slope_vat": slope * unit["deductible"]}


def expense_line(expense: Column, direct: Column, price_factor: Column) -> dict[str, Column]:
    """What an expense costs at any price: a fixed sum, or a percentage of the contract price, of a base of its own, or
    of the direct costs. price_factor is the gross price over the net one."""
    value, percent, contract = _zero(expense["value"]), expense["kind"] == "percent", expense["base"] == "contract-price"
    of = F.when(contract, 0.0).when(expense["base"] == "custom", _zero(expense["custom_base"])).otherwise(direct)
    fixed = F.when(~_flag(expense["enabled"]), 0.0).when(percent, of * value / 100).otherwise(value)
    slope = F.when(_flag(expense["enabled"]) & percent & contract, value / 100 * F.when(expense["price_base"] == "gross", price_factor).otherwise(1.0)).otherwise(0.0)
    return _line(fixed, slope, _unit(expense, _flag(expense["enabled"]) & _flag(expense["included"])))


def agent_line(agent: Column, price_factor: Column) -> dict[str, Column]:
    value, present = _zero(agent["value"]), _flag(agent["present"])
    fixed = F.when(present & (agent["kind"] == "fixed"), value).otherwise(0.0)
    slope = F.when(present & ~F.coalesce(agent["kind"] == "fixed", F.lit(False)), value / 100 * F.when(agent["price_base"] == "gross", price_factor).otherwise(1.0)).otherwise(0.0)
    return _line(fixed, slope, _unit(agent, present & _flag(agent["included"])))


def stage_sums(stage: Column) -> dict[str, Column]:
    """What a payment stage adds to the waiting (share of the price times days), and its share in percent."""
    share = stage["share"].cast("double")
    return {"waited": _zero(share) / 100 * _zero(stage["delay"]), "shares": F.coalesce(share, F.lit(0.0))}


def financing_line(terms: Column, waited: Column, shares: Column, direct: Column, price_factor: Column) -> dict[str, Column]:
    """(fixed, slope) of what financing costs: waiting for payment over the stages, with their sums (one stage of what
    the advance leaves, if there are none), factoring of what is financed, guarantees, and a reserve on the direct costs."""
    given, left = F.coalesce(F.size(terms["stages"]) > 0, F.lit(False)), F.lit(100.0) - F.least(F.lit(100.0), _zero(terms["advance"]))
    waited = F.when(given, waited).otherwise(_zero(left) / 100 * _zero(terms["delay"]))
    shares = F.when(given, shares).otherwise(left)
    year = F.when(_flag(terms["monthly"]), 30.0).otherwise(365.0)
    enabled = _flag(terms["enabled"])
    slope = waited * _zero(terms["rate"]) / 100 / year + F.greatest(F.lit(0.0), shares) / 100 * _zero(terms["factoring"]) / 100
    fixed = _zero(terms["guarantees"]) + direct * _zero(terms["reserve"]) / 100
    return {"fixed": F.when(enabled, fixed).otherwise(0.0), "slope": F.when(enabled, slope * price_factor).otherwise(0.0)}


def calculation_issues(shares: Column | None = None) -> Column:
    """Array of (code, field), all of which block: negative or infinite cost or proposed_price, a warning margin below
    the least one, an infinite target, stages that don't make 100 percent, a currency part without a rate. shares: the sum
    of the stages' shares, if it is known."""
    wrong = lambda v: v.isNull() | F.isnan(v) | (v == float("inf")) | (v < 0)
    issue = lambda code, field: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))
    stages = F.coalesce(F.col("financing.stages"), F.array())
    if shares is None:
        shares = F.aggregate(stages, F.lit(0.0), lambda s, x: s + F.coalesce(x["share"].cast("double"), F.lit(0.0)))
    rules = [
        (wrong(F.col("cost.amount").cast("double")), issue("invalid-data", "cost")),
        (wrong(F.col("proposed_price").cast("double")), issue("invalid-data", "proposedPrice")),
        (F.col("warning_margin") < F.col("min_margin"), issue("invalid-thresholds", "warningMargin")),
        (F.col("target").isNull() | F.isnan(F.col("target").cast("double")) | (F.abs(F.col("target").cast("double")) == float("inf")), issue("invalid-target", "targetValue")),
        ((F.size(stages) > 0) & (F.abs(shares - 100) > 0.001), issue("invalid-data", "paymentStages")),
        (_flag(F.col("currency.enabled")) & ((F.col("currency.amount") < 0) | (F.coalesce(F.col("currency.rate"), F.lit(0.0)) <= 0)), issue("invalid-data", "exchangeRate")),
    ]
    return F.array_compact(F.array(*[F.when(holds, says) for holds, says in rules]))


def price_free(df: DataFrame) -> DataFrame:
    """df with `_calc`, what no price changes: own and subcontracted costs, the currency part, the issues, and the lines
    (fixed + slope * net price) of what follows the price."""
    kept = df.columns
    factor = 1 + F.coalesce(F.col("price_vat_rate").cast("double"), F.lit(0.0)) / 100
    costs = ("net", "deductible_vat", "effective_cost")
    part = lambda s: (lambda b: {c: b[c] for c in costs})(_breakdown(s, s["amount"].cast("double")))
    df = df.withColumns({f"_own_{c}": v for c, v in part(F.col("cost")).items()})
    df = _with_sums(df, "_sub", F.coalesce("subcontractors", F.array()), part)
    df = _with_sums(df, "_stages", F.coalesce(F.col("financing.stages"), F.array()), stage_sums)
    currency = F.when(_flag(F.col("currency.enabled")), _zero(F.col("currency.amount")) * _zero(F.col("currency.rate"))).otherwise(0.0)
    df = df.withColumns({"_direct": F.col("_own_effective_cost") + F.col("_sub_effective_cost"), "_currency": currency, "_factor": factor})
    df = _with_sums(df, "_more", F.coalesce("expenses", F.array()), lambda e: expense_line(e, F.col("_direct"), F.col("_factor")))
    agent = agent_line(F.col("agent"), F.col("_factor"))
    financing = financing_line(F.col("financing"), F.col("_stages_waited"), F.col("_stages_shares"), F.col("_direct") + F.col("_currency"), F.col("_factor"))
    fields = {
        "factor": F.col("_factor"), "issues": calculation_issues(F.col("_stages_shares")), "own_net": F.col("_own_net"), "subcontractors_net": F.col("_sub_net"), "direct": F.col("_direct"), "currency": F.col("_currency"),
        "deductible": F.col("_own_deductible_vat") + F.col("_sub_deductible_vat"), **{f"agent_{c}": v for c, v in agent.items()}, **{f"financing_{c}": v for c, v in financing.items()},
        **{f"more_{c}": F.col(f"_more_{c}") for c in ("fixed", "slope", "fixed_vat", "slope_vat")},
    }
    return df.select(*kept, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_calc"))


def result_at_price(df: DataFrame, price: Column) -> DataFrame:
    """df with `result`: what the calculation comes to at a net price. Margin is infinite where the price is nothing
    and there is a loss, markup where the costs are nothing and there is a profit."""
    return results_at_prices(df, F.array(price)).drop("step")


def results_at_prices(df: DataFrame, prices: Column) -> DataFrame:
    """df with `step` and `result` for each price of an array. The rows are made after what is common to all prices, and
    the optimizer doesn't move that behind them, where it would be written out again for every use."""
    kept = [c for c in df.columns if c != "step"]
    steps = price_free(df).withColumn("_prices", prices).select(*kept, "_calc", F.posexplode("_prices").alias("step", "_price"))
    return _priced(steps, F.col("_price"), [*kept, "step"])


def _priced(df: DataFrame, price: Column, kept: list[str]) -> DataFrame:
    own = F.when(F.isnan(price) | (F.abs(price) == float("inf")), 0.0).otherwise(_zero(price))
    c = lambda name: F.col(f"_calc.{name}")
    net = F.col("_net")
    df = df.withColumn("_net", own).withColumns(
        {
            "_gross": net * c("factor"), "_more": c("more_fixed") + c("more_slope") * net, "_agent": c("agent_fixed") + c("agent_slope") * net, "_financing": c("financing_fixed") + c("financing_slope") * net,
            "_deductible": c("deductible") + c("more_fixed_vat") + c("more_slope_vat") * net + c("agent_fixed_vat") + c("agent_slope_vat") * net,
        }
    )
    df = df.withColumn("_full", c("direct") + c("currency") + F.col("_more") + F.col("_agent") + F.col("_financing")).withColumn("_profit", net - F.col("_full"))
    profit, full, infinite = F.col("_profit"), F.col("_full"), float("inf")
    rate = lambda whole, other: F.when(whole > EPSILON, profit / F.nullif(whole, F.lit(0.0)) * 100).otherwise(other)
    df = df.withColumn("_margin", rate(net, F.when(profit < 0, -infinite).otherwise(0.0)))
    bad = (F.size(c("issues")) > 0) | (profit < 0) | (F.col("_margin") < F.col("min_margin"))
    status = F.when(bad, "danger").when(F.col("_margin") < F.col("warning_margin"), "warning").otherwise("success")
    output = F.col("_gross") - net
    fields = {
        "valid": F.size(c("issues")) == 0, "issues": c("issues"), "price_net": net, "price_gross": F.col("_gross"), "output_vat": output, "deductible_vat": F.col("_deductible"), "vat_payable": output - F.col("_deductible"),
        "own_net": c("own_net"), "subcontractors_net": c("subcontractors_net"), "direct_costs": c("direct"), "additional_costs": F.col("_more"), "agent_commission": F.col("_agent"),
        "financing_cost": F.col("_financing"), "currency_cost": c("currency"), "full_costs": full, "profit": profit, "margin": F.col("_margin"), "markup": rate(full, F.when(profit > 0, infinite).otherwise(0.0)),
        "profitability": rate(full, F.lit(0.0)), "status": status,
    }
    return df.withColumn("result", F.struct(*[v.alias(n) for n, v in fields.items()])).select(*[n for n in kept if n != "result"], "result")


def price_scenarios(df: DataFrame, price: Column, points: int = 9) -> DataFrame:
    """`points` prices from 80 to 120 percent, with what the calculation comes to at each: costs follow the price."""
    return results_at_prices(df, F.array(*[price * (0.8 + i * (0.4 / max(1, points - 1))) for i in range(points)]))


def chart_range(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """(low, high) of a curve for a chart, which always shows zero: the least of the values and 0, the largest and 1;
    with more aggregates of the same groups."""
    return df.groupBy(*keys).agg(F.least(F.min(value), F.lit(0.0)).alias("low"), F.greatest(F.max(value), F.lit(1.0)).alias("high"), *more)
