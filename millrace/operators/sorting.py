"""Registry order as users see it: by the rules of Russian, numbers inside of texts by value, stable in both directions.

Texts are compared by a collation that leaves case and accents out; a run of digits is written with its length before
it, so that longer numbers come later. A comparison by a collation costs as much as reading a row, so only the distinct
texts are sorted by it, once, and rows by the places of their texts. Ties keep the order of the input, whatever the direction. Nothing is sorted in
one task: the order is a list of columns for orderBy, or a place by a prefix scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import natural_key
from millrace.operators.scan import numbered
from millrace.shared import saved

COLLATION = "ru_CI_AI"
#: What stands for a missing date and a missing number.
NO_DATE, NO_NUMBER = "9999-12-31", 9999


class SortKey(NamedTuple):
    """A column to sort by; a missing value is blank, or what `missing` says. Numbers are compared as numbers."""

    value: Column
    number: bool = False
    missing: str | float | None = None


def toggled(current: tuple[str, str] | None, column: str) -> tuple[str, str]:
    """The column and direction after a click on a column."""
    return column, "desc" if current == (column, "asc") else "asc"


def order_of(keys: list[SortKey], direction: str = "asc") -> list[Column]:
    """Columns for orderBy: a composite key is compared part after part, all in one direction; blanks before all else."""
    if direction not in ("asc", "desc"):
        raise ValueError("the direction is asc or desc")
    found = []
    for key in keys:
        value = key.value if key.missing is None else F.coalesce(key.value, F.lit(key.missing))
        shown = value.cast("double") if key.number else F.collate(natural_key(value), COLLATION)
        found.append(shown.asc_nulls_first() if direction == "asc" else shown.desc_nulls_last())
    return found


def sorted_rows(df: DataFrame, keys: list[SortKey], direction: str = "asc", position: str | None = None) -> DataFrame:
    """df in order; ties by the column of their position, else as they come in the input."""
    last = F.col(position) if position else F.monotonically_increasing_id()
    return df.orderBy(*order_of(keys, direction), last.asc())


def text_ranks(names: DataFrame) -> DataFrame:
    """(name, rank) of the distinct texts (name); ranks are in the collation's order, equal for texts that it holds equal."""
    key = F.collate(F.col("key"), COLLATION)
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.distinct().withColumn("key", natural_key(F.col("name"))).repartitionByRange(n, key).sortWithinPartitions(key)
    placed = saved(dealt.withColumn("at", F.monotonically_increasing_id()), "texts")
    first = placed.groupBy(key.alias("same")).agg(F.min("at").alias("rank"))
    return placed.join(first, key == F.col("same")).select("name", "rank")


def placed(df: DataFrame, keys: list[SortKey], direction: str, position: str) -> DataFrame:
    """df with `place`, from 1, in that order."""
    columns, order = [c for c in df.columns if c != "place"], []
    toward = {"asc": Column.asc_nulls_first, "desc": Column.desc_nulls_last}.get(direction)
    if toward is None:
        raise ValueError("the direction is asc or desc")
    for i, key in enumerate(keys):
        value = key.value if key.missing is None else F.coalesce(key.value, F.lit(key.missing))
        df = df.withColumn(f"_sort_{i}", value.cast("double") if key.number else F.coalesce(value.cast("string"), F.lit("")))
    for i, key in enumerate(keys):
        if not key.number:
            ranks = text_ranks(df.select(F.col(f"_sort_{i}").alias("name"))).select(F.col("name").alias(f"_name_{i}"), F.col("rank").alias(f"_rank_{i}"))
            df = df.join(ranks, F.col(f"_sort_{i}") == F.col(f"_name_{i}")).drop(f"_name_{i}", f"_sort_{i}").withColumnRenamed(f"_rank_{i}", f"_sort_{i}")
        order.append(toward(F.col(f"_sort_{i}")))
    return numbered(df, [*order, F.col(position).asc()], "place").select(*columns, "place")


def ranked_positive(df: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """Rows whose value is above zero, largest first, the first `most` of them."""
    found = df.where(F.col(value) > 0).orderBy(F.desc(value))
    return found if most is None else found.limit(most)
