"""Running values by a distributed prefix scan, for keys with more rows than a task should hold, or no key at all.

A window gives each key to one task. Here rows are dealt out by ranges of (key, order) and numbered in their places;
each piece of a key is scanned on its own, the pieces' totals are scanned (a row a piece), and what lies before a piece
is added to its rows. A key with all rows is as many pieces as there are partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.shared import saved

PLACE = 1 << 33  # monotonically_increasing_id() numbers the rows of a partition below this


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str | Column] | None = None, lasts: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """df with, for each row, the sums so far and the last values so far that are not null, by key and order.

    Nulls add nothing to a sum; a sum of none is 0. Null keys are a key. Rows that tie in the order come in any order.
    """
    sums, lasts = sums or {}, lasts or {}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    values = {f"_of_{n}": F.coalesce(col(c), F.lit(0)) for n, c in sums.items()} | {f"_of_{n}": c for n, c in lasts.items()}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = [*keys, *map(col, order)]
    dealt = df.withColumns(values).repartitionByRange(n, *ranges).sortWithinPartitions(*ranges)
    # bounds of ranges are sampled: written once, so that all that follows sees the same pieces
    placed = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "scan").withColumn("_piece", F.floor(F.col("_at") / PLACE).cast("int"))

    piece = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"_own_{n}": F.sum(f"_of_{n}").over(piece) for n in sums} | {f"_own_{n}": F.last(f"_of_{n}", ignorenulls=True).over(piece) for n in lasts})

    totals = [F.sum(f"_of_{n}").alias(f"_of_{n}") for n in sums] + [F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), F.col("_at"))).alias(f"_of_{n}") for n in lasts]
    pieces = placed.groupBy(*keys, "_piece").agg(*totals)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.sum(f"_of_{n}").over(before).alias(f"_before_{n}") for n in sums] + [F.last(f"_of_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in lasts]
    prefix = pieces.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_piece").alias("_of_piece"), *earlier)

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_piece") == F.col("_of_piece"))
    found = {n: F.coalesce(F.col(f"_before_{n}"), F.lit(0)) + F.col(f"_own_{n}") for n in sums} | {n: F.coalesce(f"_own_{n}", f"_before_{n}") for n in lasts}
    return own.join(prefix, same).select(*[c for c in df.columns if c not in found], *[c.alias(n) for n, c in found.items()])


def numbered(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`, the place of each row in the order, from 1. A row's place in its piece is known when the piece is
    written, so no row is shuffled again."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), "scan").withColumn("_piece", F.shiftright("_at", 33))
    earlier = F.coalesce(F.sum("_rows").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = placed.groupBy("_piece").agg(F.count("*").alias("_rows")).select(F.col("_piece").alias("_of_piece"), earlier.alias("_before"))
    place = F.col("_before") + F.col("_at") % PLACE + 1
    return placed.join(F.broadcast(before), F.col("_piece") == F.col("_of_piece")).select(*[c for c in df.columns if c != name], place.alias(name))
