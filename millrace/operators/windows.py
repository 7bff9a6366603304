"""Ordered operators: running balances, retention, fill-forward, version chains, eviction, page windows.

Where a key may have more rows than a task should hold, or where there is none, `hot` takes a prefix scan instead of a
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import running


def cash_flow(df: DataFrame, keys: list[str], order: list[str], date: Column, amount: str = "amount", hot: bool = False) -> DataFrame:
    """Closing balance, largest gap below zero and the date at which the balance first reaches its minimum."""
    if hot:
        summed = running(df, keys, order, sums={"bal": amount})
    else:
        summed = df.withColumn("bal", F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    balance = summed.withColumn("bal", F.round("bal", 6)).withColumn("at", F.struct(*order))
    lowest = F.min(F.struct("bal", "at", date.alias("day")))
    return balance.groupBy(*keys).agg(F.round(F.sum(amount), 6).alias("closing_balance"), lowest.alias("low")).select(
        *keys, "closing_balance", F.abs(F.least("low.bal", F.lit(0.0))).alias("cash_gap"), F.when(F.col("low.bal") < 0, F.col("low.day")).alias("gap_date")
    )


def keep_latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts groups to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a pre-aggregated maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, "_last.*")


def version_chain(df: DataFrame, keys: list[str], order: list[str], version: str) -> DataFrame:
    """Each row with the version that it supersedes and whether a later one has made it stale."""
    chain = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("supersedes", F.lag(version).over(chain)).withColumn("stale", F.lead(version).over(chain).isNotNull())


def evict(df: DataFrame, keys: list[str], order: list[Column], size: str, most_rows: int, most_size: int, hot: bool = False) -> DataFrame:
    """Rows that a cache drops: beyond a rank or a running sum of sizes, in order of use."""
    beyond = (F.col("rank") > most_rows) | (F.col("running") > most_size)
    if hot:
        return running(df, keys, order, sums={"rank": F.lit(1), "running": size}).where(beyond)
    used = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(used)).withColumn("running", F.sum(size).over(used.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(beyond)


def rotate(df: DataFrame, keys: list[str], order: list[Column], keep: int, too_old: Column) -> DataFrame:
    """Backups that rotation drops: beyond the newest `keep`, or too old."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where((F.col("rank") > keep) | too_old)


def forward_fill(df: DataFrame, keys: list[str], order: list[str], marker: Column, columns: list[str], hot: bool = False) -> DataFrame:
    """Columns of the last row up to this one whose marker holds."""
    marked = F.when(marker, F.struct(*columns))
    if hot:
        filled = running(df, keys, order, lasts={"_last": marked})
    else:
        filled = df.withColumn("_last", F.last(marked, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumns({f"filled_{c}": F.col(f"_last.{c}") for c in columns}).drop("_last")


def page_window(df: DataFrame, keys: list[str], order: str, radius: int = 8) -> DataFrame:
    """Neighbours at +1, +2 and -1 and the places that a pager shows around each page: all of a short list."""
    run = Window.partitionBy(*keys).orderBy(order)
    total = F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumn("place", F.row_number().over(run) - 1).withColumn("total", total.cast("int"))
    short = F.col("total") <= 2 * radius + 5
    return (
        out.withColumn("next1", F.lead(order, 1).over(run)).withColumn("next2", F.lead(order, 2).over(run)).withColumn("previous", F.lag(order, 1).over(run))
        .withColumn("first_shown", F.when(short, 0).otherwise(F.greatest(F.lit(0), F.col("place") - radius)))
        .withColumn("last_shown", F.when(short, F.col("total") - 1).otherwise(F.least(F.col("total") - 1, F.col("place") + radius)))
    )


def share_of_max(df: DataFrame, keys: list[str], value: str, hot: bool = False) -> DataFrame:
    """Rank by value and percentage of the group's maximum, taken as 1 at least."""
    if hot:
        first = running(df, keys, [F.desc(value), "label"], sums={"rank": F.lit(1)})
        largest = df.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(1.0)).alias("_largest"))
        both = first.join(largest, keys) if keys else first.join(F.broadcast(largest), F.lit(True))
        return both.withColumn("share", F.round(F.col(value) / F.col("_largest") * 100, 6)).drop("_largest")
    group = Window.partitionBy(*keys)
    share = F.col(value) / F.greatest(F.max(value).over(group), F.lit(1.0)) * 100
    return df.withColumn("share", F.round(share, 6)).withColumn("rank", F.row_number().over(group.orderBy(F.desc(value), "label")))
