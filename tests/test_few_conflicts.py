"""Interval conflicts of keys with few rows, which are paired outright, against those of large keys."""

import random

from millrace.operators import planning


def intervals(spark, n=300):
    rng, day = random.Random(5), lambda d: None if d < 0 else f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}"
    rows = []
    for i in range(n):
        s = rng.randrange(250)
        rows.append((i % 7 if i % 11 else None, i, day(-1 if i % 13 == 0 else s), day(-1 if i % 17 == 0 else max(0, s + rng.randrange(-5, 70))), float(rng.randrange(1, 100))))
    return spark.createDataFrame(rows, "k int, id int, s string, e string, load double").selectExpr("k", "id", "date(s) AS s", "date(e) AS e", "load")


def test_few_and_many_rows_conflict_alike(spark):
    df = intervals(spark)
    found = [sorted(map(tuple, planning.interval_conflicts(df, "k", "id", "s", "e", "load", 90.0, few=few).collect())) for few in (0, 38, 1000)]
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]


def test_few_rows_are_not_dealt_out(spark):
    found = planning.interval_conflicts(intervals(spark, 60), "k", "id", "s", "e", "load", 90.0)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
