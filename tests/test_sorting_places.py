"""Places in registry order: only distinct texts are sorted by the collation."""

from pyspark.sql import functions as F

from millrace.operators import scan, sorting

LABELS = ["Résumé 10", "resume 9", None, "resume 10", "", "Договор 2", "договор 02", "RESUME 9"]


def places(spark, direction, **more):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LABELS)], "id long, label string")
    found = sorting.placed(df, [sorting.SortKey(F.col("label"), **more)], direction, "id")
    return [r.id for r in found.orderBy("place").collect()], found


def test_places_follow_the_collation_and_ties_the_position(spark):
    up, found = places(spark, "asc")
    assert found.columns == ["id", "label", "place"] and sorted(r.place for r in found.collect()) == list(range(1, 9))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LABELS)], "id long, label string")
    for direction in ("asc", "desc"):
        want = [r.id for r in df.orderBy(*sorting.order_of([sorting.SortKey(F.col("label"))], direction), F.col("id")).collect()]
        assert places(spark, direction)[0] == want
    assert up[:2] == [2, 4] and [i for i in up if i in (1, 7)] == [1, 7] and [i for i in up if i in (0, 3)] == [0, 3]


def test_rows_are_not_sorted_by_the_collation_or_scanned_again(spark, monkeypatch):
    plans, write = {}, scan.saved
    monkeypatch.setattr(scan, "saved", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, label))
    _, found = places(spark, "asc")
    sorts = [line for line in plans["scan"].lower().splitlines() if "sort [" in line]
    assert sorts and not any("collate" in line for line in sorts)
    assert "_of_place" not in found._jdf.queryExecution().optimizedPlan().toString()
