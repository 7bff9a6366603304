"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

Each source's documents, in hash order, form blocks of `block` documents. Of `period` slots a source of weight w
gets a = w * period (whole by largest remainders, at least 1). Its j-th block of a period (from 0) is released at
floor(j * period / a) and due at ceil((j + 1) * period / a); every slot goes to the released block that is due
first. The weights sum to 1, so all blocks are served in time, and after every slot each source is less than one
block away from its share. Periods repeat, so one schedule of `period` slots places any number of blocks.

The place of a document in its source needs no sort of the source: its hash falls into a bucket, and buckets are
counted and summed up in two levels of 256, so a source with a third of all rows is many small groups.

A source that runs out leaves its slots to the others, whose order stays; nothing is dropped or repeated.

Defined results: sources without a weight, the null source among them, share the weight `rest` as one source.
Rows with a null id come first in one bucket of their source; ties of repeated rows are broken arbitrarily, as
they are equal. An empty table gives no rows. Columns besides the id and the source are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_SLOTS = 10_000


def quotas(weights: list[float], period: int) -> list[int]:
    """Slots of each weight: largest remainders, at least one each."""
    if not weights or min(weights) <= 0 or len(weights) > period or period > MOST_SLOTS:
        raise ValueError(f"weights must be positive and no more than the period, which is at most {MOST_SLOTS}")
    spare = period - len(weights)
    exact = [w / sum(weights) * period for w in weights]
    over = [max(x - 1, 0.0) for x in exact]
    scale = spare / (sum(over) or 1)
    whole = [1 + int(x * scale + 1e-9) for x in over]
    order = sorted(range(len(weights)), key=lambda i: (whole[i] - 1 - over[i] * scale, i))
    for i in order[: period - sum(whole)]:
        whole[i] += 1
    return whole


def slot_table(spark: SparkSession, shares: list[int]) -> DataFrame:
    """(source index, turn, slot) of one period: earliest deadline first among the released blocks."""
    period, n = sum(shares), len(shares)
    due = f"""array_min(filter(transform(sequence(0, {n - 1}), i -> struct(
        ((s.done[i] + 1) * {period}) div shares[i] + int((s.done[i] + 1) * {period} % shares[i] > 0) AS due, i AS i, (s.done[i] * {period}) div shares[i] AS release)),
        b -> b.release <= t AND s.done[b.i] < shares[b.i])).i"""
    step = f"""transform(array({due}), p -> named_struct('done', transform(s.done, (d, i) -> d + int(i = p)), 'picks', concat(s.picks, array(p))))[0]"""
    table = spark.sql(f"SELECT array({', '.join(map(str, shares))}) AS shares")
    picks = F.expr(f"aggregate(sequence(0, {period - 1}), named_struct('done', array_repeat(0, {n}), 'picks', CAST(array() AS array<int>)), (s, t) -> {step}, s -> s.picks)")
    served = table.select(F.posexplode(picks).alias("slot", "source_index"))
    turn = F.row_number().over(Window.partitionBy("source_index").orderBy("slot")) - 1
    return served.select("source_index", turn.alias("turn"), "slot")


def mix(docs: DataFrame, weights: dict[str, float], rest: float, block: int = 32, period: int = 1000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row struct, source_index, block, slot, place) of every row; order by (slot, place) is the mix."""
    names = list(weights)
    shares = quotas([*weights.values(), rest], period)
    index = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(source_col)).cast("int"), F.lit(0)) - 1
    index = F.when(index < 0, len(names)).otherwise(index)
    digest = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("0000"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), index.alias("source_index"), digest.alias("digest"), F.col(id_col).alias("id"))
    rows = rows.withColumn("b1", F.substring("digest", 1, 2)).withColumn("b2", F.substring("digest", 3, 2))

    # how many documents of the source lie before each bucket
    counts = rows.groupBy("source_index", "b1", "b2").agg(F.count("*").alias("n"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("before2", F.coalesce(F.sum("n").over(earlier("source_index", "b1", "b2")), F.lit(0)))
    outer = rows.groupBy("source_index", "b1").agg(F.count("*").alias("n")).withColumn("before1", F.coalesce(F.sum("n").over(earlier("source_index", "b1")), F.lit(0)))
    before = inner.drop("n").join(outer.drop("n"), ["source_index", "b1"]).select("source_index", "b1", "b2", (F.col("before1") + F.col("before2")).alias("before"))

    bucket = Window.partitionBy("source_index", "b1", "b2").orderBy("digest", "id")
    ranked = rows.withColumn("local", F.row_number().over(bucket) - 1).join(before, ["source_index", "b1", "b2"])
    rank = F.col("before") + F.col("local")
    share = F.element_at(F.array(*[F.lit(a) for a in shares]), F.col("source_index") + 1).cast("long")
    placed = ranked.select("row", "source_index", F.floor(rank / block).alias("block"), (rank % block).cast("int").alias("place")).withColumn("turn", (F.col("block") % share).cast("int"))
    # the schedule has `period` rows, at most MOST_SLOTS
    slots = F.broadcast(slot_table(docs.sparkSession, shares))
    slot = F.floor(F.col("block") / share) * period + F.col("slot")
    return placed.join(slots, ["source_index", "turn"]).select("row", "source_index", "block", slot.alias("slot"), "place")


def mixed(docs: DataFrame, weights: dict[str, float], rest: float, **how) -> DataFrame:
    """The rows of docs in the order of the mix: partitions, and rows in partitions, follow it."""
    return mix(docs, weights, rest, **how).orderBy("slot", "place", "source_index").select("row.*")
