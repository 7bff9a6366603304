"""Planning operators: daily load, interval conflicts, calendars, people for schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions.money import js_round
from millrace.shared import saved

#: Rows of a key whose pairs are made outright.
FEW = 100


def staff_load(assignments: DataFrame, start: str, end: str, hours_a_day: float = 8.0, limit: float = 8.01) -> DataFrame:
    """Hours, capacity, load and overloaded days of everyone in a range of days.

    assignments: (staff, start_date, end_date, hours); hours spread evenly over the business days of the whole
    assignment. Only days inside the range are listed.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    whole = F.greatest(F.lit(1), dates.n_business_days(F.col("start_date"), F.col("end_date")))
    daily = assignments.where((F.col("start_date") <= hi) & (F.col("end_date") >= lo)).select(
        "staff", (F.col("hours") / whole).alias("hours"), F.explode(dates.business_days(F.greatest("start_date", lo), F.least("end_date", hi))).alias("day")
    )
    by_day = daily.groupBy("staff", "day").agg(F.sum("hours").alias("hours"))
    capacity = dates.n_business_days(lo, hi) * hours_a_day
    return by_day.groupBy("staff").agg(F.sum("hours").alias("planned"), F.count_if(F.col("hours") > limit).alias("overloaded_days")).select(
        "staff", F.round("planned", 6).alias("planned"), capacity.alias("capacity"), F.round(F.when(capacity > 0, F.col("planned") / capacity * 100).otherwise(0.0), 6).alias("load_percent"), "overloaded_days"
    )


def interval_conflicts(df: DataFrame, key: str, id_col: str, start: str, end: str, load: str, most: float, bucket_days: int = 30, few: int = FEW) -> DataFrame:
    """Pairs (first_id < second_id) of one key that overlap and exceed the load together. An interval with a missing bound
    overlaps all of its key; one that ends before it starts overlaps only those.

    Of a pair that exceeds the load one is heavy, with more than half of it, so light rows never meet each other. In keys
    of at most `few` rows each heavy row meets all others: that costs less than dealing rows out. In larger ones dated
    intervals meet in buckets of days, wider by powers of two for longer ones, each with those as long in two or three
    buckets and with longer ones in theirs. Open intervals and their partners meet by load: what a heavy row may go with is
    all above a load, and that is a few nodes of a binary tree of loads, so nearly every pair that is made is a result.
    """
    rows = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(load).cast("double").alias("load"))
    rows = rows.where("k IS NOT NULL AND load IS NOT NULL").withColumns({"heavy": F.col("load") * 2 > most, "open": F.col("s").isNull() | F.col("e").isNull()})
    large = saved(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > few).select("k"), "large-keys")
    if large.isEmpty():
        pairs = _few_pairs(rows, most)
    else:
        many = rows.join(large, "k", "left_semi")
        pairs = _few_pairs(rows.join(large, "k", "left_anti"), most).unionByName(_dated_pairs(many.where("NOT open AND s <= e"), most, bucket_days)).unionByName(_open_pairs(many, most))
    ids = [f("id_a", "id_b") for f in (F.least, F.greatest)]
    return pairs.select(F.col("k").alias(key), ids[0].alias("first_id"), ids[1].alias("second_id"), F.round(F.col("load_a") + F.col("load_b"), 6).alias("load"))


def _few_pairs(rows: DataFrame, most: float) -> DataFrame:
    a, b = (side.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "s", "e", "load", "heavy", "open")]) for x, side in (("a", rows.where("heavy")), ("b", rows)))
    meet = "open_a OR open_b OR (s_a <= e_a AND s_b <= e_b AND s_a <= e_b AND s_b <= e_a)"
    found = a.join(b, "k").where(f"id_a <> id_b AND (NOT heavy_b OR id_a < id_b) AND ({meet})").where(F.col("load_a") + F.col("load_b") > most)
    return found.select("k", "id_a", "id_b", "load_a", "load_b")


def _dated_pairs(rows: DataFrame, most: float, bucket_days: int) -> DataFrame:
    number = lambda day, level: F.floor(F.unix_date(day) / (bucket_days * F.pow(F.lit(2), level)))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.datediff("e", "s") + 1) / F.lit(float(bucket_days))))).cast("int")
    leveled = rows.withColumn("own", level)
    # a key has as many levels as octaves of length, some 20 at most
    levels = leveled.groupBy("k").agg(F.collect_set("own").alias("levels"))
    met = leveled.join(levels, "k").withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("own"))))
    met = met.withColumn("first", number(F.col("s"), F.col("level"))).withColumn("bucket", F.explode(F.sequence("first", number(F.col("e"), F.col("level")))))
    a, b = (side.select("k", "level", "bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "s", "e", "load", "first", "own", "heavy")]) for x, side in (("a", met.where("heavy")), ("b", met)))
    once = "bucket = greatest(first_a, first_b) AND (own_a = level OR own_b = level) AND (NOT heavy_b OR id_a < id_b)"
    found = a.join(b, ["k", "level", "bucket"]).where(f"{once} AND id_a <> id_b AND s_a <= e_b AND s_b <= e_a").where(F.col("load_a") + F.col("load_b") > most)
    return found.select("k", "id_a", "id_b", "load_a", "load_b")


def _open_pairs(rows: DataFrame, most: float, depth: int = 12) -> DataFrame:
    side = lambda df, x: df.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "load", "open")])
    heavy, light = rows.where("heavy"), rows.where("NOT heavy")
    # two heavy ones always exceed the load
    both = side(heavy.where("open"), "a").join(side(heavy, "b"), "k").where("id_a <> id_b AND (NOT open_b OR id_a < id_b)")

    leaves = 1 << depth
    leaf = lambda x: F.greatest(F.lit(0), F.least(F.lit(leaves - 1), F.floor(x / (abs(most) / 2 or 1.0) * leaves))).cast("int")
    at = lambda j, of: F.struct(F.lit(j).alias("height"), of.alias("node"))
    up = [at(j, F.shiftright("leaf", j)) for j in range(depth)]
    # all leaves above a heavy row's own bound, as whole subtrees, and that leaf itself
    above = [F.when(F.shiftright("leaf", j) % 2 == 0, at(j, F.shiftright("leaf", j) + 1)) for j in range(depth)]
    asks = heavy.withColumn("leaf", leaf(most - F.col("load"))).withColumn("n", F.explode(F.array_compact(F.array(at(0, F.col("leaf")), *above))))
    told = light.withColumn("leaf", leaf(F.col("load"))).withColumn("n", F.explode(F.array(*up)))
    found = []
    for a, b in ((asks.where("open"), told), (asks.where("NOT open"), told.where("open"))):
        # only of keys where one of them is open
        b = b.join(a.select("k").distinct(), "k", "left_semi")
        sides = [df.select("k", "n.height", "n.node", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "load", "open")]) for df, x in ((a, "a"), (b, "b"))]
        found.append(sides[0].join(sides[1], ["k", "height", "node"]).where("id_a <> id_b").where(F.col("load_a") + F.col("load_b") > most))
    columns = ["k", "id_a", "id_b", "load_a", "load_b"]
    return both.select(*columns).unionByName(found[0].select(*columns)).unionByName(found[1].select(*columns))


def calendar(schedules: DataFrame, start: str, end: str, id_col: str, order: list[str], most: int = 4) -> DataFrame:
    """The first `most` schedules of every day from start to end, with the day's total."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    live = schedules.where((F.col("start_date") <= F.col("end_date")) & (F.col("start_date") <= hi) & (F.col("end_date") >= lo))
    days = live.withColumn("day", F.explode(F.sequence(F.greatest("start_date", lo), F.least("end_date", hi))))
    # counted apart, so that the rank can cut days before the shuffle
    totals = days.groupBy("day").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    shown = days.withColumn("place", rank).where(F.col("place") <= most)
    return shown.join(totals, "day").select("day", "place", id_col, "total")


def qualification(status_ok: Column, skills: Column, text: Column, years: Column, required_years: Column, disclosure: Column, named: Column) -> Column:
    """Score from 0 to 100: skills 55 (40 if none is asked for), experience 30, disclosure 10, a qualification 5."""
    found = F.size(F.filter(skills, lambda s: F.contains(F.lower(text), s)))
    skill = F.when(F.size(skills) > 0, found / F.nullif(F.size(skills), F.lit(0)) * 55).otherwise(40.0)
    experience = F.when(required_years == 0, 30.0).otherwise(F.least(F.lit(30.0), years / F.nullif(required_years, F.lit(0)) * 30))
    whole = skill + experience + F.when(disclosure, 10.0).otherwise(0.0) + F.when(named, 5.0).otherwise(0.0)
    return F.when(status_ok, js_round(F.least(F.lit(100.0), whole))).otherwise(0)


def recommendation(score: Column, load: Column, outside: Column) -> Column:
    return F.greatest(F.lit(0), js_round(score * 0.7 + F.greatest(F.lit(0.0), 100 - load) * 0.3 - F.when(outside, 35).otherwise(0)))
