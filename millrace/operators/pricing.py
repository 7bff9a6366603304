"""Pricing operators: closed-form target prices, scenarios, ladders, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import safe_ratio

CAP = 1e12


def solve_target(fixed: Column, ratio: Column, target: Column, by_margin: Column) -> Column:
    """(price, error): the net price at which profit reaches the target margin or markup in percent.

    Full cost is fixed + ratio * price, so the price is found directly. Targets at or above the ceiling that the
    ratio allows are unreachable; without a fixed cost margin and markup are constant, and no search converges.
    """
    k = 1 + target / 100
    slope = F.when(by_margin, 1 - ratio - target / 100).otherwise(1 - k * ratio)
    price = F.when(by_margin, fixed).otherwise(k * fixed) / F.nullif(slope, F.lit(0.0))
    ceiling = F.when(by_margin, (1 - ratio) * 100).otherwise(F.when(ratio > 0, (1 - ratio) / F.nullif(ratio, F.lit(0.0)) * 100).otherwise(F.lit(float("inf"))))
    error = (
        F.when((target >= ceiling) | (slope <= 0), "unreachable-target")
        .when((fixed == 0) & ~(by_margin & (target == 0)), "target-not-converged")
        .when(price > CAP, "unreachable-target")
    )
    price = F.when(fixed == 0, 1e-7).otherwise(price)
    return F.struct(F.when(error.isNull(), price).alias("price"), error.alias("error"))


def result_at(price: Column, fixed: Column, ratio: Column) -> Column:
    """(cost, profit, margin, markup) at a net price; infinite where price or cost is zero and the other isn't."""
    cost = fixed + ratio * price
    profit = price - cost
    low = F.lit(float("-inf"))
    margin = F.when(price == 0, F.when(profit < 0, low).otherwise(0.0)).otherwise(profit / F.nullif(price, F.lit(0.0)) * 100)
    markup = F.when(cost == 0, F.when(profit > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(profit / F.nullif(cost, F.lit(0.0)) * 100)
    return F.struct(cost.alias("cost"), profit.alias("profit"), margin.alias("margin"), markup.alias("markup"))


def recommend_price(floor: Column, lowest_offer: Column) -> Column:
    """A little under the lowest offer (1000 or half a percent), but no less than the floor."""
    return F.when(lowest_offer.isNull(), floor).otherwise(F.greatest(floor, lowest_offer - F.greatest(F.lit(1000.0), lowest_offer * 0.005)))


def scenarios(df: DataFrame, price: Column, cost: Column) -> DataFrame:
    """Nine prices from 80 to 120 percent, with profit and margin."""
    out = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("price", price * (0.8 + F.col("step") * 0.05))
    return out.withColumn("profit", F.col("price") - cost).withColumn("margin", safe_ratio(F.col("profit"), F.col("price")) * 100)


def rebid_ladder(df: DataFrame, start: Column, cost: Column, steps: int, percent: float, preset: str) -> DataFrame:
    """Falling offers down to the preset's floor: 1.15 of cost (comfort), 1.03 (working-minimum) or none (any-price)."""
    if not 1 <= steps <= 20 or not 0 < percent <= 50:
        raise ValueError("steps from 1 to 20, percent above 0 and at most 50")
    floor = {"comfort": 1.15, "working-minimum": 1.03}.get(preset, 0.0)
    out = df.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    raw = start * (1 - F.lit(percent) / 100 * (F.col("number") - 1))
    out = out.withColumn("price", F.greatest(cost * floor, raw)).withColumn("profit", F.col("price") - cost)
    return out.withColumn("reduction", start - F.col("price")).withColumn("margin", safe_ratio(F.col("profit"), F.col("price")) * 100).withColumn("loss", F.col("profit") < 0)


def scenario_financials(gross: Column, rate: Column, costs: Column, partner_share: Column, minimum: Column, strict: bool = False) -> Column:
    """Net price, VAT, full cost, profit, margin, markup and headroom; null for a VAT rate outside 0..100, or an error
    if `strict`."""
    net = gross / (1 + rate / 100)
    full = costs + net * F.greatest(F.lit(0.0), partner_share) / 100
    profit = net - full
    fields = {"net": net, "vat": gross - net, "full_cost": full, "profit": profit, "margin": safe_ratio(profit, net) * 100, "markup": safe_ratio(profit, full) * 100, "headroom": gross - minimum}
    found = F.when(rate.between(0, 100), F.struct(*[v.alias(k) for k, v in fields.items()]))
    return found.otherwise(F.raise_error(F.lit("a VAT rate must be from 0 to 100 percent"))) if strict else found


def go_no_go(df: DataFrame, keys: list[str]) -> DataFrame:
    """(score, decision) from criteria (weight, status, blocking); status: met, conditional, failed, unassessed."""
    weight = F.greatest(F.lit(0.0), F.col("weight"))
    earned = weight * F.when(F.col("status") == "met", 1.0).when(F.col("status") == "conditional", 0.5).otherwise(0.0)
    sums = df.groupBy(*keys).agg(
        F.sum(weight).alias("total"), F.sum(earned).alias("earned"), F.count("*").alias("n"), F.count_if(F.col("status") != "unassessed").alias("assessed"),
        F.bool_or(F.col("blocking") & (F.col("status") == "failed")).alias("failure"), F.bool_or(F.col("blocking") & F.col("status").isin("conditional", "unassessed")).alias("pending"),
    )
    score = F.when(F.col("total") > 0, F.col("earned") / F.nullif("total", F.lit(0.0)) * 100).otherwise(0.0)
    scored = sums.withColumn("score", F.round(score, 6))
    decision = (
        F.when(F.col("assessed") == 0, "undecided").when(F.col("failure") | (F.col("score") < 40), "no")
        .when(F.col("pending") | (F.col("assessed") < F.col("n")) | (F.col("score") < 75), "conditional").otherwise("yes")
    )
    return scored.select(*keys, "score", decision.alias("decision"))


def cost_structure(df: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """(part, amount, share): each part of the whole, as rows; profit below zero counts as zero."""
    summed = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in parts.items()])
    clipped = {n: F.greatest(F.lit(0.0), F.col(n)) if n == "profit" else F.col(n) for n in parts}
    whole = sum(clipped.values(), F.lit(0.0))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("amount"), (safe_ratio(c, whole) * 100).alias("share")) for n, c in clipped.items()])).alias("p")
    return summed.select(*keys, rows).select(*keys, "p.part", F.round("p.amount", 4).alias("amount"), F.round("p.share", 6).alias("share"))
