"""Goldens and edge cases of the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import graph, history, matching, planning, pricing, registry, scan, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cash_flow(spark):
    df = spark.createDataFrame([(1, 2, "2026-02-01", 150.0), (1, 1, "2026-01-01", -100.0), (2, 1, "2026-01-01", 5.0)], "k int, id int, day string, amount double")
    assert rows(windows.cash_flow(df, ["k"], ["day", "id"], F.col("day"))) == [(1, 50.0, 100.0, "2026-01-01"), (2, 5.0, 0.0, None)]


def test_forward_fill_takes_number_of_the_customer_row(spark):
    df = spark.createDataFrame([(1, "A", "n1"), (2, "", "x"), (3, "B", ""), (4, "", "y")], "i int, customer string, number string").withColumn("k", F.lit(1))
    out = windows.forward_fill(df, ["k"], ["i"], F.col("customer") != "", ["customer", "number"])
    assert rows(out.select("i", "filled_customer", "filled_number")) == [(1, "A", "n1"), (2, "A", "n1"), (3, "B", ""), (4, "B", "")]


def test_page_window(spark):
    df = spark.createDataFrame([("s", i) for i in range(21)] + [("l", i) for i in range(40)], "k string, i int")
    out = {(r.k, r.i): r for r in windows.page_window(df, ["k"], "i").collect()}
    assert (out["s", 3].first_shown, out["s", 3].last_shown) == (0, 20)
    assert (out["l", 20].first_shown, out["l", 20].last_shown, out["l", 20].next2, out["l", 20].previous) == (12, 28, 22, 19)


def test_nested_filters_differ(spark):
    df = spark.createDataFrame([(1, [("X", "a"), ("Y", "b")]), (2, [("X", "b")])], "id int, a array<struct<dept string, pos string>>")
    wanted = {"dept": "X", "pos": "b"}
    assert [r.id for r in registry.any_of(df, "a", wanted).collect()] == [1, 2] and [r.id for r in registry.one_of(df, "a", wanted).collect()] == [2]
    assert registry.one_of(df, "a", {"dept": ""}).count() == 2


def test_repeats_with_nulls(spark):
    df = spark.createDataFrame([(1, "A "), (2, "a"), (3, None), (4, None), (5, "b")], "id int, name string")
    assert rows(registry.repeats(df, [F.lower(F.trim("name"))], ["id"]).select("id")) == [(2,), (4,)]


def test_upsert_match(spark):
    old = spark.createDataFrame([(1, "n1", "e1"), (2, "n1", "e2"), (3, "n2", "e1"), (4, "n3", "e1"), (5, "n3", "e1")], "id int, num string, ent string")
    new = spark.createDataFrame([(10, "n1", "e2"), (11, "n1", None), (12, "n2", "zz"), (13, "n9", ""), (14, "n3", "e1")], "row int, num string, ent string")
    assert rows(registry.upsert_match(new, old, "id", "num", ["ent"])) == [(10, 1, 2), (11, 2, None), (12, 1, 3), (13, 0, None), (14, 2, None)]


def test_upsert_match_of_whole_tables(spark):
    """All against all of one key, which pairs of candidates would make 40 billion of."""
    n = 200_000
    own = spark.range(n).selectExpr("id", "'k' AS num", "CAST(id % 100000 AS STRING) AS ent", "CAST(id AS STRING) AS day")
    new = own.selectExpr("id AS row", "num", "CASE WHEN id % 4 > 0 THEN ent END AS ent", "CASE WHEN id % 2 = 0 THEN day ELSE '' END AS day")
    got = registry.upsert_match(new, own, "id", "num", ["ent", "day"])
    assert got.where("matched IS NOT NULL AND matched <> row").isEmpty()
    assert rows(got.groupBy("candidates", (F.col("row") % 4).alias("r")).count()) == [(1, 0, 50_000), (1, 2, 50_000), (2, 1, 50_000), (2, 3, 50_000)]


def test_staff_load(spark):
    d = dt.date(2026, 3, 2)
    df = spark.createDataFrame([("a", d, dt.date(2026, 3, 3), 12.0), ("a", d, dt.date(2026, 3, 3), 8.0), ("b", d, d, 4.0)], "staff string, start_date date, end_date date, hours double")
    assert rows(planning.staff_load(df, "2026-03-02", "2026-03-03")) == [("a", 20.0, 16.0, 125.0, 2), ("b", 4.0, 16.0, 25.0, 0)]


def test_interval_conflicts_equal_all_pairs(spark):
    rng = random.Random(1)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    data = []
    for i in range(300):
        s = rng.randrange(200)
        data.append((rng.choice(["x", "x", "y", None]), i, day(s) if rng.random() > 0.05 else None, day(s + rng.randrange(0, 90)) if rng.random() > 0.05 else None, float(rng.randrange(20, 90))))
    want = set()
    for a in data:
        for b in data:
            if a[0] and a[0] == b[0] and a[1] < b[1] and (None in (a[2], a[3], b[2], b[3]) or (a[2] <= b[3] and b[2] <= a[3])) and a[4] + b[4] > 100:
                want.add((a[0], a[1], b[1], a[4] + b[4]))
    found = rows(planning.interval_conflicts(spark.createDataFrame(data, "k string, i int, s date, e date, l double"), "k", "i", "s", "e", "l", 100))
    assert set(found) == want and len(found) == len(want)


def test_pricing(spark):
    one = spark.range(1)
    at = lambda f, r, t, m: one.select(pricing.solve_target(F.lit(f), F.lit(r), F.lit(t), F.lit(m)).alias("s")).select("s.*").first()
    price = at(1_075_000.0, 0.0, 20.0, True).price
    assert (price - 1_075_000) / price * 100 == pytest.approx(20, abs=1e-5)
    assert at(100.0, 0.9, 20.0, True).error == "unreachable-target" and at(0.0, 0.02, 20.0, True).error == "target-not-converged" and at(0.0, 0.02, 0.0, True).price == 1e-7
    rng = random.Random(2)
    for _ in range(20):
        f, r, t, m = rng.uniform(1, 1e6), rng.uniform(0, 1.2), rng.uniform(0, 80), rng.random() < 0.5
        s = at(f, r, t, m)
        if s.error is None:
            cost = f + r * s.price
            assert (s.price - cost) / (s.price if m else cost) * 100 == pytest.approx(t, rel=1e-9)
        else:
            assert t >= ((1 - r) * 100 if m else (1 - r) / r * 100) or s.error
    ladder = pricing.rebid_ladder(spark.createDataFrame([(100.0, 80.0)], "nmc double, cost double"), F.col("nmc"), F.col("cost"), 3, 10, "comfort")
    assert [round(r.price, 9) for r in ladder.orderBy("number").collect()] == [100, 92, 92]
    s = one.select(pricing.scenario_financials(F.lit(122.0), F.lit(22.0), F.lit(75.0), F.lit(0.0), F.lit(100.0)).alias("s")).select("s.*").first()
    assert [round(x, 6) for x in (s.net, s.vat, s.full_cost, s.profit, s.margin, s.headroom)] == [100, 22, 75, 25, 25, 22]
    assert one.select(pricing.scenario_financials(F.lit(1.0), F.lit(101.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()[0] is None


def test_go_no_go(spark):
    data = [("a", 50.0, "met", False), ("a", 50.0, "failed", True), ("b", 10.0, "unassessed", False), ("c", 3.0, "met", True), ("c", 1.0, "conditional", False), ("d", 1.0, "met", True), ("d", -5.0, "conditional", True)]
    out = pricing.go_no_go(spark.createDataFrame(data, "k string, weight double, status string, blocking boolean"), ["k"])
    assert rows(out) == [("a", 50.0, "no"), ("b", 0.0, "undecided"), ("c", 87.5, "yes"), ("d", 100.0, "conditional")]


def test_contract_rules(spark):
    df = spark.createDataFrame([(1, "Заказчик вправе изменить объём. Оплата в течение 120 календарных дней."), (2, "Пени не взимаются"), (3, "неограниченная ответственность"), (4, None)], "id int, t string")
    assert [(a, b, d) for a, b, _, d in rows(matching.rule_hits(df, "id", "t", matching.CONTRACT_RULES))] == [(1, "payment-delay", "120 календарных дней"), (1, "unilateral-scope", "Заказчик вправе измен"), (2, "penalties", "Пени")]


def test_history(spark):
    old = spark.createDataFrame([("1", '{"id": 1, "name": "a", "updatedAt": "x", "list": [{"v": 1}, 2], "relativePath": "attachments/f.pdf"}'), ("2", "not json"), ("3", None)], "id string, p string")
    new = spark.createDataFrame([("1", '{"id": 2, "name": "b", "updatedAt": "y", "list": [{"v": 1}], "relativePath": "attachments/f.pdf"}')], "id string, p string")
    a, b = history.flatten_json(old, "id", "p"), history.flatten_json(new, "id", "p")
    assert rows(history.diff(a, b)) == [("1", "list.№ 2", "2", "—"), ("1", "name", "a", "b")]
    assert rows(history.paths_in(a)) == [("attachments/f.pdf",)]


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("g", "g")], "child string, parent string")
    assert rows(graph.on_cycle(edges)) == [("a",), ("b",), ("c",), ("g",)]
    assert rows(graph.on_cycle(edges.where("child = 'e'"))) == []
    # what lies between two cycles is on none, and a cycle may run through another one's node
    joined = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "h"), ("h", "e"), (None, "a")]
    assert rows(graph.on_cycle(spark.createDataFrame(joined, "child string, parent string"))) == [(x,) for x in "abdefh"]


def test_long_cycles(spark):
    ring = [(i, (i * 7 + 1) % 1_000) for i in range(1_000)] + [(5_000 + i, 5_001 + i) for i in range(30)]
    want, seen = set(), dict(ring)
    for i in range(1_000):
        at = seen[i]
        for _ in range(1_000):
            if at == i:
                want.add(i)
                break
            at = seen[at]
    assert {r.node for r in graph.on_cycle(spark.createDataFrame(ring, "child long, parent long")).collect()} == want


def test_contradictory_roles(spark):
    companies = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "id long, name string, inn string")
    relations = spark.createDataFrame([(1, 2, "head"), (1, 2, "branch"), (2, 1, "head"), (1, 9, "head"), (1, 9, "branch")], "source long, target long, type string")
    assert rows(graph.directory_issues(companies, relations)) == [(1, "contradictory-role"), (1, "dangling")]


def merged_in_turn(cards):
    """Card after card: by INN, else by the entity last opened under the name."""
    by_name, by_inn, inn_of, of = {}, {}, {}, {}
    for i, name, inn in sorted(cards):
        match = by_name.get(name) if name is not None else None
        hit = by_inn.get(inn) if inn else None
        if hit is None and match is not None and (not inn or not inn_of[match] or inn_of[match] == inn):
            hit = match
        if hit is None:
            hit = i
            inn_of[i] = inn
            if name is not None:
                by_name[name] = i
        inn_of[hit] = inn_of[hit] or inn
        if inn:
            by_inn[inn] = hit
        of[i] = hit
    return sorted(of.items())


@pytest.mark.parametrize("seed", range(3))
def test_entities_depend_on_order(spark, seed):
    rng = random.Random(seed)
    cards = [(i, rng.choice(["hub", "hub", *[f"n{j}" for j in range(25)], "", None]), rng.choice(["", "", *map(str, range(60))])) for i in range(400)]
    found = graph.merge_entities(spark.createDataFrame(rng.sample(cards, len(cards)), "i long, n string, x string"), "n", "x", "i")
    assert sorted(map(tuple, found.collect())) == merged_in_turn(cards)
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def test_entities_along_a_shuffled_chain(spark):
    rng = random.Random(9)
    cards = [(i, f"n{i // 2}", str((i + 1) // 2)) for i in range(5000)]
    places = rng.sample(range(5000), 5000)
    cards = [(p, n, x) for p, (_, n, x) in zip(places, cards, strict=True)]
    assert sorted(map(tuple, graph.merge_entities(spark.createDataFrame(cards, "i long, n string, x string"), "n", "x", "i").collect())) == merged_in_turn(cards)


def test_merged_cards(spark):
    ddl = "i long, name string, inn string, kpp string, scope string, source string, archived boolean"
    cards = spark.createDataFrame([(1, "a", "", "", "external", "contracts", True), (2, "a", "7", "k2", "internal", "contracts", True), (3, "b", "7", "k3", "external", "manual", False), (4, "c", "", "", "external", "manual", True)], ddl)
    entities = graph.merge_entities(cards, "name", "inn", "i")
    assert rows(graph.merged_cards(cards, entities, "i", ["inn", "kpp"])) == [(1, "a", "7", "k2", "internal", "manual", False), (4, "c", "", "", "external", "manual", True)]
    relations = spark.createDataFrame([(4, 2, "head", ""), (4, 3, "head", ""), (2, 9, "other", "")], "source long, target long, type string, note string")
    assert rows(graph.merged_relations(relations, entities)) == [(1, 9, "other", ""), (4, 1, "head", "")]


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_running_values_of_a_hot_key(spark, keys):
    from pyspark.sql import Window

    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(2), i, rng.choice([None, *range(-5, 9)]), rng.random() < 0.1) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, j int, i int, v int, m boolean").repartition(7)
    got = scan.running(df, keys, [F.desc("i")], sums={"n": F.lit(1), "total": "v"}, lasts={"last": F.when(F.col("m"), F.struct("i", "v"))}, partitions=9)
    w = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.row_number().over(w), "total": F.coalesce(F.sum("v").over(w), F.lit(0)), "last": F.last(F.when(F.col("m"), F.struct("i", "v")), ignorenulls=True).over(w)})
    assert rows(got.select(want.columns)) == rows(want)


def test_running_values_are_dealt_out(spark):
    """One key with all rows: no piece holds more than twice the median."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("o"), "id")
    placed = scan.running(df, ["k"], ["o"], sums={"n": F.lit(1)}, partitions=8)
    assert placed.agg(F.max("n")).first()[0] == 40_000
    dealt = df.repartitionByRange(8, "k", "o").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_hot_variants_equal_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, i, float(rng.randrange(-50, 50)), f"l{i:04d}", rng.random() < 0.2) for i in range(500)], "k int, i int, amount double, label string, mark boolean")
    for f in (
        lambda hot: windows.cash_flow(df, ["k"], ["i"], F.col("i"), hot=hot),
        lambda hot: windows.forward_fill(df, ["k"], ["i"], F.col("mark"), ["amount"], hot=hot).select("i", "filled_amount"),
        lambda hot: windows.evict(df, ["k"], [F.desc("i")], "i", 100, 20_000, hot=hot).select("i", "rank", "running"),
        lambda hot: windows.share_of_max(df, ["k"], "amount", hot=hot).select("i", "share", "rank"),
    ):
        assert rows(f(True)) == rows(f(False))


def plain_conflicts(data, most):
    out = []
    for i, a in enumerate(data):
        for b in data[:i]:
            if a[1] == b[1] and None not in (a[1], a[4], b[4]) and a[4] + b[4] > most and (None in (*a[2:4], *b[2:4]) or a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]):
                out.append((a[1], *sorted((a[0], b[0])), round(a[4] + b[4], 6)))
    return sorted(out)


@pytest.mark.parametrize("most", [10.0, 0.0, -3.0])
def test_interval_conflicts_of_all_lengths(spark, most):
    rng, day = random.Random(6), dt.date(2020, 1, 1)
    data = []
    for i in range(300):
        s = day + dt.timedelta(rng.randrange(4000))
        e = s + dt.timedelta(rng.choice([-5, 0, 1, 20, 29, 30, 31, 200, 3000, 20_000]))
        data.append((i, rng.choice(["x", "y", None]), rng.choice([s, s, None]), rng.choice([e, e, None]), rng.choice([None, -2.0, 0.0, 2.5, 4.9, 5.0, 5.1, 8.0, 12.0, rng.random() * 10])))
    df = spark.createDataFrame(data, "i int, k string, s date, e date, load double")
    assert sorted(map(tuple, planning.interval_conflicts(df, "k", "i", "s", "e", "load", most).collect())) == plain_conflicts(data, most)


def test_light_open_intervals_make_no_pairs(spark):
    df = spark.range(100_000).select("id", F.lit("k").alias("k"), F.lit(None).cast("date").alias("s"), F.lit(None).cast("date").alias("e"), F.lit(3.0).alias("load"))
    assert planning.interval_conflicts(df, "k", "id", "s", "e", "load", 10.0).count() == 0


def test_overlap_rank_equals_all_pairs(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    texts = [(i, " ".join(["common", *rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(6))])) for i in range(400)]
    asks = [(i, " ".join(["common"] * (i % 3 > 0) + rng.choices(words, k=i % 5))) for i in range(30)]
    want = []
    for n, t in asks:
        scores = sorted((-len({*t.split()} & {*c.split()}), i) for i, c in texts)
        want += [(n, i, -s, r) for r, (s, i) in enumerate([x for x in scores if x[0]][:7], 1)]
    found = matching.overlap_rank(spark.createDataFrame(asks, "n int, t string"), spark.createDataFrame(texts, "i int, t string"), "n", F.split("t", " "), "i", F.split("t", " "), 7)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_overlap_rank_makes_few_pairs(spark, monkeypatch):
    """A word in every text makes no pairs for needs that have another."""
    made = []
    scored = matching._scored
    monkeypatch.setattr(matching, "_scored", lambda pairs, *more: (made.append(pairs.count()), scored(pairs, *more))[1])
    texts = spark.range(20_000).select("id", F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id") % 1000)).alias("w"))
    asks = spark.range(50).select(F.col("id").alias("n"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("q"))
    found = matching.overlap_rank(asks, texts, "n", F.col("q"), "id", F.col("w"), 10)
    assert found.where("relevance = 2").count() == 500 and sum(made) <= 50 * 10 * 5  # of 1,000,000


def test_overlap_rank(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta"), (3, None)], "id int, t string")
    out = matching.overlap_rank(spark.createDataFrame([(9, "Alpha BETA words")], "need int, t string"), docs, "need", text.tokens(F.col("t")), "id", text.tokens(F.col("t")), 5)
    assert rows(out) == [(9, 1, 2, 1), (9, 2, 1, 2)]


def test_json_leaves(spark):
    texts = {
        1: '{"a": {"b": [1, {"c": "x"}, []], "e": {}}, "t": true, "n": null, "s": "[not {nested"}',
        2: '[[["deep"]], 1.50, -2e3, 0]', 3: "broken {", 4: None, 5: "", 6: '"alone"', 7: "{}", 8: '{"q": "say \\"{\\" ü", "dot.ted": 1}',
    }
    found = history.flatten_json(spark.createDataFrame(list(texts.items()), "id int, p string"), "id", "p")
    assert sorted(map(tuple, found.collect())) == sorted([
        (1, "a.b.№ 1", "1"), (1, "a.b.№ 2.c", "x"), (1, "a.b.№ 3", "[]"), (1, "a.e", "{}"), (1, "t", "true"), (1, "n", "null"), (1, "s", "[not {nested"),
        (2, "№ 1.№ 1.№ 1", "deep"), (2, "№ 2", "1.5"), (2, "№ 3", "-2000.0"), (2, "№ 4", "0"), (8, "q", 'say "{" ü'), (8, "dot.ted", "1"),
    ])
    assert "Python" not in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="deep"):
        history.flatten_json(spark.createDataFrame([(1, "[[[]]]")], "id int, p string"), "id", "p", most_depth=2)
