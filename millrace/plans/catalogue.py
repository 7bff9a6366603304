"""The query catalogue: every query by name with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, money, pages, text
from millrace.operators import graph, history, matching, planning, pricing, registry, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIGNED = "CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END"


@query(f"""
WITH e AS (SELECT user_id, event_id, ts, {SIGNED} AS amount FROM events),
r AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bal FROM e),
m AS (SELECT user_id, round(least(min(bal), 0), 6) AS lo, round(sum(amount), 6) AS closing_balance FROM r GROUP BY user_id)
SELECT m.user_id, m.closing_balance, abs(m.lo) AS cash_gap,
  (SELECT min(strftime(r.ts, '%Y-%m-%d')) FROM r WHERE r.user_id = m.user_id AND m.lo < 0 AND round(r.bal, 6) = m.lo) AS gap_date
FROM m""")
def cash_flow_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(SIGNED).alias("amount"))
    return windows.cash_flow(events, ["user_id"], ["ts", "event_id"], F.date_format("ts", "yyyy-MM-dd"))


# ---- windows and retention


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def history_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return windows.keep_latest(events, ["user_id"], [F.desc("event_id")], 20)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY o_custkey")
def latest_version_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = windows.latest_version(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w IS NOT NULL AS stale
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return windows.version_chain(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "supersedes", "stale")


@query("""SELECT doc_id, rank, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS rank, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS running
FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id DESC)) WHERE rank > 15 OR running > 30000""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return windows.evict(docs, ["source", "lang"], [F.desc("doc_id")], "n_chars", 15, 30_000).select("doc_id", "rank", "running")


@query("""SELECT o_orderkey, rank FROM (SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS rank
FROM orders WHERE o_orderstatus <> 'P') WHERE rank > 5 OR o_orderdate < TIMESTAMP '1996-01-01'""")
def rotation_rank_or_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderdate", "o_orderkey")
    return windows.rotate(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "rank")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS filled_value,
last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS filled_source
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.col("event_id").alias("source"))
    return windows.forward_fill(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", ["value", "source"]).select("event_id", "filled_value", "filled_source")


@query("""SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS total, lead(turn) OVER w AS next1, lead(turn, 2) OVER w AS next2, lag(turn) OVER w AS previous,
CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) <= 7 THEN 0 ELSE greatest(0, row_number() OVER w - 2) END AS INTEGER) AS first_shown,
CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) <= 7 THEN count(*) OVER (PARTITION BY conv_id) - 1 ELSE least(count(*) OVER (PARTITION BY conv_id) - 1, row_number() OVER w) END AS INTEGER) AS last_shown
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.page_window(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", radius=1)


@query("""WITH u AS (SELECT p_type, CAST(p_partkey AS VARCHAR) AS label, p_retailprice AS price FROM part UNION ALL SELECT DISTINCT p_type, 'own offer', 950.0 FROM part)
SELECT p_type, label, CAST(row_number() OVER (PARTITION BY p_type ORDER BY price DESC, label) AS INTEGER) AS rank, round(price / greatest(max(price) OVER (PARTITION BY p_type), 1) * 100, 6) AS share FROM u""")
def share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    offers = part.select("p_type", F.col("p_partkey").cast("string").alias("label"), F.col("p_retailprice").alias("price"))
    own = part.select("p_type", F.lit("own offer").alias("label"), F.lit(950.0).alias("price")).distinct()
    return windows.share_of_max(offers.unionByName(own), ["p_type"], "price").select("p_type", "label", "rank", "share")


# ---- registry


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey
WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, o_orderpriority)), '7 building 1-urg') AND o_orderstatus = 'F'""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    fields = [F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderpriority")]
    return registry.search(joined, fields, "7 Building 1-URG", {"o_orderstatus": "F", "c_mktsegment": ""}).select("o_orderkey", "c_name")


@query("""SELECT conv_id, bool_or(role = 'user' AND turn = 2) AS same_entry FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(turn = 2)""")
def exists_nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("turn").cast("string").alias("turn"))).alias("turns"))
    wanted = {"role": "user", "turn": "2"}
    any_turn = registry.any_of(nested, "turns", wanted)
    one = registry.one_of(any_turn, "turns", wanted).select("conv_id", F.lit(True).alias("same"))
    return any_turn.join(one, "conv_id", "left").select("conv_id", F.coalesce("same", F.lit(False)).alias("same_entry"))


@query("""SELECT c.c_custkey, coalesce(n.n_name, m.n_name) AS n_name, coalesce(n.n_regionkey, m.n_regionkey) AS n_regionkey, coalesce(r.r_name, 'unassigned') AS r_name FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 0 LEFT JOIN nation m ON n.n_nationkey IS NULL AND m.n_name = 'NATION_' || (c.c_custkey % 30)
LEFT JOIN region r ON r.r_regionkey = coalesce(n.n_regionkey, m.n_regionkey)""")
def lookup_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("nation_id"), F.concat(F.lit("NATION_"), F.col("c_custkey") % 30).alias("nation"))
    found = registry.lookup(customer, table(spark, sf_dir, "nation"), ("nation_id", "n_nationkey"), (F.col("nation"), "n_name"), ["n_name", "n_regionkey"])
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return found.join(region, "n_regionkey", "left").select("c_custkey", "n_name", "n_regionkey", F.coalesce("r_name", F.lit("unassigned")).alias("r_name"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -900)""")
def semi_or_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    big = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    debt = table(spark, sf_dir, "supplier").where("s_acctbal < -900")
    return registry.used_by_either(customer, [(big, "o_custkey", "c_custkey"), (debt, "s_nationkey", "c_nationkey")]).select("c_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '2001-01-01'").select("o_custkey")
    return registry.dangling(orders, "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')")
def not_yet_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'")
    return registry.dangling(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", linked, "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING' WHERE c_custkey IS NULL")
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    internal = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return registry.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", internal, "c_custkey")


@query("""SELECT count(*) AS orphan_count, coalesce(CAST(sum(p_size) AS BIGINT), 0) AS orphan_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01' AND l_shipdate < TIMESTAMP '2000-07-01')
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def orphan_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    month, large = line.where("l_shipdate >= TIMESTAMP '2000-06-01' AND l_shipdate < TIMESTAMP '2000-07-01'"), line.where("l_quantity > 49")
    return registry.orphans(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", [(month, "l_partkey"), (large, "l_partkey")])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(lang)), md5(text), n_chars ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def dup_detection_4key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    return registry.repeats(docs, [F.lower(F.trim("lang")), F.col("digest"), F.col("n_chars")], ["doc_id"]).select("doc_id")


@query("""WITH i AS (SELECT c_custkey AS row, c_mktsegment || c_nationkey AS seg, CASE WHEN c_custkey % 2 = 0 THEN floor(c_acctbal / 500) END AS nat, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS bal FROM customer),
a AS (SELECT i.*, c.c_custkey AS m, floor(c.c_acctbal / 500) AS n, c.c_custkey % 7 AS b FROM i LEFT JOIN customer c ON c.c_mktsegment || c.c_nationkey = seg),
s1 AS (SELECT *, (m IS NOT NULL) AS k, count(m) OVER (PARTITION BY row) AS n1 FROM a),
s2 AS (SELECT *, k AND (n1 <= 1 OR nat IS NULL OR nat IS NOT DISTINCT FROM n) AS k2 FROM s1),
s3 AS (SELECT *, sum(k2::INT) OVER (PARTITION BY row) AS n2 FROM s2),
s4 AS (SELECT *, k2 AND (n2 <= 1 OR bal IS NULL OR bal IS NOT DISTINCT FROM b) AS k3 FROM s3)
SELECT row, CAST(sum(k3::INT) AS INTEGER) AS candidates, CASE WHEN sum(k3::INT) = 1 THEN min(m) FILTER (k3) END AS matched FROM s4 GROUP BY row""")
def upsert_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("seg")
    customer = table(spark, sf_dir, "customer").select("c_custkey", seg, F.floor(F.col("c_acctbal") / 500).cast("string").alias("band"), (F.col("c_custkey") % 7).cast("string").alias("week"))
    incoming = customer.select(F.col("c_custkey").alias("row"), "seg", F.expr("CASE WHEN c_custkey % 2 = 0 THEN band END").alias("band"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN week END").alias("week"))
    return registry.upsert_match(incoming, customer, "c_custkey", "seg", ["band", "week"])


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part)
WHERE trim(coalesce(value, '')) <> '' GROUP BY 1, 2""")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.facets(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


AS_OF = "2000-06-15"


@query(f"""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate < DATE '{AS_OF}') AS overdue,
count(*) FILTER (date_diff('day', DATE '{AS_OF}', o_orderdate::DATE) + 1 BETWEEN 0 AND 7) AS urgent, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS awaiting FROM orders GROUP BY 1""")
def conditional_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, status = F.to_date("o_orderdate"), F.col("o_orderstatus")
    left = dates.days_until(day, F.lit(AS_OF).cast("date"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), F.count_if(status == "O").alias("active"), F.count_if((status != "F") & (day < F.lit(AS_OF).cast("date"))).alias("overdue"),
        F.count_if(left.between(0, 7)).alias("urgent"), F.round(F.coalesce(F.sum(F.when(status == "P", F.col("o_totalprice"))), F.lit(0.0)), 2).alias("awaiting"),
    )


@query("SELECT 'region' AS module, CAST(r_regionkey AS BIGINT) AS id, r_name AS title FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_acctbal < 0")
def module_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda name, key, title: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), F.col(title).alias("title"))
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return registry.tagged_union({"region": pick("region", "r_regionkey", "r_name"), "nation": pick("nation", "n_nationkey", "n_name"), "supplier": supplier})


TONES = {"F": "success", "O": "warning"}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'warning' ELSE 'neutral' END AS tone FROM orders")
def tone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.tone(F.col("o_orderstatus"), TONES).alias("tone"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def latest_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return windows.keep_latest(events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 10).select("event_type", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def selected_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A")).join(chosen, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, u.code, u.severity FROM (SELECT *, [CASE WHEN l_discount > l_tax + 0.05 THEN {'code': 'deep-discount', 'severity': 'error'} END,
CASE WHEN l_quantity > 45 THEN {'code': 'bulk', 'severity': 'warning'} END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN {'code': 'open-return', 'severity': 'error'} END] AS c FROM lineitem), unnest(c) AS t(u) WHERE u IS NOT NULL""")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        ("deep-discount", "error", F.col("l_discount") > F.col("l_tax") + 0.05),
        ("bulk", "warning", F.col("l_quantity") > 45),
        ("open-return", "error", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
    ]
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.explode(registry.failed_checks(line, checks)).alias("c")).select("l_orderkey", "l_linenumber", "c.code", "c.severity")


# ---- planning


@query("""WITH a AS (SELECT l_suppkey AS staff, l_shipdate::DATE AS s, (l_shipdate::DATE + CAST(l_quantity AS INTEGER)) AS e, l_quantity / 2 AS hours FROM lineitem),
n AS (SELECT *, greatest(1, (SELECT count(*) FROM generate_series(s, e, INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6)) AS days FROM a WHERE s <= DATE '2000-03-31' AND e >= DATE '2000-03-01'),
d AS (SELECT staff, hours / days AS h, unnest(generate_series(greatest(s, DATE '2000-03-01'), least(e, DATE '2000-03-31'), INTERVAL 1 DAY)) AS day FROM n),
p AS (SELECT staff, day, sum(h) AS h FROM d WHERE isodow(day) < 6 GROUP BY 1, 2)
SELECT staff, round(sum(h), 6) AS planned, 184.0::DOUBLE AS capacity, round(sum(h) / 184.0 * 100, 6) AS load_percent, count(*) FILTER (h > 8.01) AS overloaded_days FROM p GROUP BY staff""")
def staff_load_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.to_date("l_shipdate")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("staff"), ship.alias("start_date"), F.date_add(ship, F.col("l_quantity").cast("int")).alias("end_date"), (F.col("l_quantity") / 2).alias("hours"))
    return planning.staff_load(line, "2000-03-01", "2000-03-31")


INTERVALS = """SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 50 <> 0 THEN l_shipdate::DATE END AS s, CASE WHEN l_orderkey % 50 <> 1 THEN (l_shipdate::DATE + CAST(l_quantity AS INTEGER)) END AS e, l_quantity * 2 AS load FROM lineitem"""


@query(f"""WITH i AS ({INTERVALS}) SELECT a.part, a.id AS first_id, b.id AS second_id, round(a.load + b.load, 6) AS load FROM i a JOIN i b ON a.part = b.part AND a.id < b.id
WHERE (a.s IS NULL OR a.e IS NULL OR b.s IS NULL OR b.e IS NULL OR (a.s <= b.e AND b.s <= a.e)) AND a.load + b.load > 100""")
def interval_overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.to_date("l_shipdate")
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_orderkey") % 50 != 0, ship).alias("s"),
        F.when(F.col("l_orderkey") % 50 != 1, F.date_add(ship, F.col("l_quantity").cast("int"))).alias("e"), (F.col("l_quantity") * 2).alias("load"),
    )
    return planning.interval_conflicts(line, "part", "id", "s", "e", "load", 100)


@query("""WITH d AS (SELECT o_orderkey, unnest(generate_series(greatest(o_orderdate::DATE, DATE '1998-05-25'), least(o_orderdate::DATE + 10, DATE '1998-07-05'), INTERVAL 1 DAY))::DATE AS day FROM orders WHERE o_orderdate::DATE <= DATE '1998-07-05' AND o_orderdate::DATE + 10 >= DATE '1998-05-25'),
r AS (SELECT day, o_orderkey, CAST(row_number() OVER (PARTITION BY day ORDER BY o_orderkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY day) AS total FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, place, o_orderkey, total FROM r WHERE place <= 4""")
def calendar_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    schedules = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("start_date"), F.date_add(day, 10).alias("end_date"))
    return planning.calendar(schedules, "1998-05-25", "1998-07-05", "o_orderkey", ["o_orderkey"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH q AS (SELECT s_suppkey, r.r_name, s_acctbal, floor(least(100, (CASE WHEN contains(lower(s_name || ' ' || n_name), '1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(s_name || ' ' || n_name), 'nation_2') THEN 1 ELSE 0 END) / 2.0 * 55
 + least(30, (s_suppkey % 12) / 7.0 * 30) + CASE WHEN s_acctbal > 0 THEN 10 ELSE 0 END + 5) + 0.5) AS qualification, (s_suppkey * 7 % 130)::DOUBLE AS load, n_regionkey <> r.r_regionkey AS outside
 FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region r ON r.r_regionkey IN (n_regionkey, (n_regionkey + 1) % 5)),
s AS (SELECT *, greatest(0, floor(qualification * .7 + greatest(0, 100 - load) * .3 - CASE WHEN outside THEN 35 ELSE 0 END + 0.5)) AS score FROM q WHERE qualification > 0)
SELECT r_name, s_suppkey, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r_name ORDER BY score DESC, load, s_suppkey) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def recommend_cross_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    # everyone is ranked for their own region and the next one, which is outside their availability
    asked = supplier.withColumn("r_regionkey", F.explode(F.array("n_regionkey", (F.col("n_regionkey") + 1) % 5)))
    asked = asked.join(table(spark, sf_dir, "region"), "r_regionkey")
    skills = F.array(F.lit("1"), F.lit("nation_2"))
    score = planning.qualification(F.lit(True), skills, F.concat_ws(" ", "s_name", "n_name"), (F.col("s_suppkey") % 12).cast("double"), F.lit(7), F.col("s_acctbal") > 0, F.lit(True))
    load = (F.col("s_suppkey") * 7 % 130).cast("double")
    scored = asked.withColumn("qualification", score).where("qualification > 0").withColumn("load", load)
    scored = scored.withColumn("score", planning.recommendation(F.col("qualification"), F.col("load"), F.col("n_regionkey") != F.col("r_regionkey")))
    best = windows.keep_latest(scored, ["r_name"], [F.desc("score"), F.col("load"), F.col("s_suppkey")], 10)
    rank = F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("score"), "load", "s_suppkey"))
    return best.select("r_name", "s_suppkey", "score", rank.alias("rank"))


@query(f"""SELECT o_orderkey, date_diff('day', DATE '{AS_OF}', d) AS days_to, date_diff('day', DATE '{AS_OF}', d) + 1 AS days_until,
CASE WHEN o_orderpriority = '5-LOW' THEN 'unlimited' WHEN o_orderstatus = 'P' THEN 'missing' WHEN d < DATE '{AS_OF}' THEN 'expired' WHEN date_diff('day', DATE '{AS_OF}', d) < 60 THEN 'expiring' ELSE 'valid' END AS category,
strftime(greatest(d - 5, d - 2), '%Y-%m-%d') AS internal FROM (SELECT *, o_orderdate::DATE AS d FROM orders)""")
def deadline_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    today, day = F.lit(AS_OF).cast("date"), F.to_date("o_orderdate")
    expires = F.when(F.col("o_orderstatus") != "P", day)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.days_to(day, today).cast("long").alias("days_to"), dates.days_until(day, today).cast("long").alias("days_until"),
        dates.expiry(F.col("o_orderpriority") == "5-LOW", expires, today, 60).alias("category"), F.date_format(dates.internal_deadline(F.date_sub(day, 5), day, today), "yyyy-MM-dd").alias("internal"),
    )


# ---- prices


@query("""SELECT l_orderkey, l_linenumber, round(p / (1 + r / 100), 4) AS net, round(p, 4) AS gross, round(greatest(0, p - p / (1 + r / 100)), 4) AS input_vat, round(CASE WHEN d AND r > 0 THEN greatest(0, p - p / (1 + r / 100)) ELSE 0 END, 4) AS deductible_vat,
round(p - CASE WHEN d AND r > 0 THEN greatest(0, p - p / (1 + r / 100)) ELSE 0 END, 4) AS effective_cost FROM (SELECT *, l_extendedprice AS p, CASE WHEN l_linestatus = 'O' THEN l_tax * 100 ELSE 0 END AS r, l_returnflag = 'N' AND l_linestatus = 'O' AS d FROM lineitem)""")
def vat_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    payer = F.col("l_linestatus") == "O"
    cost = money.cost_breakdown(F.col("l_extendedprice"), F.col("l_tax") * 100, F.lit(True), payer, F.col("l_returnflag") == "N")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("c"))
    return line.select("l_orderkey", "l_linenumber", *[F.round(f"c.{x}", 4).alias(x) for x in ("net", "gross", "input_vat", "deductible_vat", "effective_cost")])


@query("""SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount ELSE 250.0 END), 4) AS expenses,
round(sum(l_extendedprice * greatest(0, l_tax * 100) / 100 * 0.24 * l_quantity / 365), 4) AS financing FROM lineitem GROUP BY 1""")
def expense_and_financing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "percent").otherwise("fixed")
    value = F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 100).otherwise(250.0)
    expense = money.expense_amount(kind, value, F.col("l_extendedprice"), F.col("l_returnflag") != "R")
    stages = F.array(F.struct((F.col("l_tax") * 100).alias("share"), F.col("l_quantity").alias("delay")))
    wait = money.financing(F.col("l_extendedprice"), stages, F.lit(24.0), monthly=False)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(expense), 4).alias("expenses"), F.round(F.sum(wait), 4).alias("financing"))


@query("""WITH c AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS f, (l_orderkey % 12) / 10.0::DOUBLE AS r, (l_orderkey % 41)::DOUBLE AS t, l_orderkey % 2 = 0 AS m FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE WHEN m THEN 1 - r - t / 100 ELSE 1 - (1 + t / 100) * r END AS slope, CASE WHEN m THEN (1 - r) * 100 WHEN r > 0 THEN (1 - r) / r * 100 ELSE 'infinity'::DOUBLE END AS ceiling FROM c),
p AS (SELECT *, t >= ceiling OR slope <= 0 AS bad, CASE WHEN slope > 0 THEN CASE WHEN m THEN f ELSE (1 + t / 100) * f END / slope END AS price FROM s)
SELECT l_orderkey, CASE WHEN bad OR price > 1e12 THEN 'unreachable-target' END AS error, round(CASE WHEN NOT bad AND price <= 1e12 THEN price END, 8) AS price,
round(CASE WHEN NOT bad AND price <= 1e12 THEN CASE WHEN m THEN (price - f - r * price) / price * 100 ELSE (price - f - r * price) / (f + r * price) * 100 END END, 4) AS reached FROM p""")
def solve_target_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("fixed"))
    ratio, target, by_margin = (F.col("l_orderkey") % 12) / 10.0, (F.col("l_orderkey") % 41).cast("double"), F.col("l_orderkey") % 2 == 0
    solved = costs.withColumn("s", pricing.solve_target(F.col("fixed"), ratio, target, by_margin)).withColumn("at", pricing.result_at(F.col("s.price"), F.col("fixed"), ratio))
    return solved.select("l_orderkey", "s.error", F.round("s.price", 8).alias("price"), F.round(F.when(by_margin, F.col("at.margin")).otherwise(F.col("at.markup")), 4).alias("reached"))


@query("""WITH o AS (SELECT l_partkey, min(CASE WHEN l_returnflag = 'N' THEN l_extendedprice WHEN l_returnflag = 'A' THEN l_extendedprice * (1 + l_tax) ELSE l_extendedprice * (1 + l_discount) END) AS low FROM lineitem GROUP BY 1)
SELECT p_partkey, round(CASE WHEN low IS NULL THEN p_retailprice * 3 ELSE greatest(p_retailprice * 3, low - greatest(1000, low * 0.005)) END, 4) AS price FROM part LEFT JOIN o ON l_partkey = p_partkey""")
def recommend_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = F.when(F.col("l_returnflag") == "N", "gross").when(F.col("l_returnflag") == "A", "net").otherwise("adjusted")
    price = money.comparable_price(F.col("l_extendedprice"), F.col("l_tax") * 100, how, F.col("l_discount") * 100)
    low = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(price).alias("low"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").join(low, "p_partkey", "left")
    return part.select("p_partkey", F.round(pricing.recommend_price(F.col("p_retailprice") * 3, F.col("low")), 4).alias("price"))


@query("""SELECT p_partkey, CAST(s AS INTEGER) AS step, round(p_retailprice * (0.8 + s * 0.05), 4) AS price, round(p_retailprice * (0.8 + s * 0.05) - p_retailprice * 0.9, 4) AS profit,
round((p_retailprice * (0.8 + s * 0.05) - p_retailprice * 0.9) / (p_retailprice * (0.8 + s * 0.05)) * 100, 4) AS margin FROM part, generate_series(0, 8) g(s)""")
def price_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    out = pricing.scenarios(part, F.col("p_retailprice"), F.col("p_retailprice") * 0.9)
    return out.select("p_partkey", "step", *[F.round(c, 4).alias(c) for c in ("price", "profit", "margin")])


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS number, round(price, 6) AS price, round(p_retailprice - price, 6) AS reduction, round(price - p_retailprice * 0.75, 6) AS profit, price - p_retailprice * 0.75 < 0 AS loss
FROM (SELECT *, greatest(p_retailprice * 0.75 * 1.15, p_retailprice * (1 - 4 / 100.0::DOUBLE * (k - 1))) AS price FROM part, generate_series(1, 6) g(k))""")
def rebid_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    out = pricing.rebid_ladder(part, F.col("p_retailprice"), F.col("p_retailprice") * 0.75, 6, 4, "comfort")
    return out.select("p_partkey", "number", *[F.round(c, 6).alias(c) for c in ("price", "reduction", "profit")], "loss")


@query("""SELECT o_orderkey, round(n, 6) AS net, round(g - n, 6) AS vat, round(f, 6) AS full_cost, round(n - f, 6) AS profit, round((n - f) / n * 100, 6) AS margin, round((n - f) / f * 100, 6) AS markup, round(g - 1000, 6) AS headroom
FROM (SELECT *, g * 0.6 + n * greatest(0, o_orderkey % 30 - 5) / 100 AS f FROM (SELECT o_orderkey, o_totalprice AS g, o_totalprice / (1 + (o_orderkey % 23) / 100.0::DOUBLE) AS n FROM orders))""")
def scenario_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    s = pricing.scenario_financials(price, (key % 23).cast("double"), price * 0.6, (key % 30 - 5).cast("double"), F.lit(1000.0))
    out = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return out.select("o_orderkey", *[F.round(f"s.{c}", 6).alias(c) for c in ("net", "vat", "full_cost", "profit")], F.round("s.margin", 6).alias("margin"), F.round("s.markup", 6).alias("markup"), F.round("s.headroom", 6).alias("headroom"))


CRITERIA = "CASE l_returnflag WHEN 'N' THEN 'met' WHEN 'A' THEN 'conditional' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'unassessed' ELSE 'failed' END END"


@query(f"""WITH c AS (SELECT l_orderkey, greatest(0, l_quantity - 5) AS w, {CRITERIA} AS s, l_tax > 0.07 AS b FROM lineitem),
g AS (SELECT l_orderkey, sum(w) AS t, sum(w * CASE s WHEN 'met' THEN 1 WHEN 'conditional' THEN 0.5 ELSE 0 END) AS e, count(*) AS n, count(*) FILTER (s <> 'unassessed') AS a, bool_or(b AND s = 'failed') AS f, bool_or(b AND s IN ('conditional', 'unassessed')) AS p FROM c GROUP BY 1),
r AS (SELECT *, round(CASE WHEN t > 0 THEN e / t * 100 ELSE 0 END, 6) AS score FROM g)
SELECT l_orderkey, score, CASE WHEN a = 0 THEN 'undecided' WHEN f OR score < 40 THEN 'no' WHEN p OR a < n OR score < 75 THEN 'conditional' ELSE 'yes' END AS decision FROM r""")
def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - 5).alias("weight"), F.expr(CRITERIA).alias("status"), (F.col("l_tax") > 0.07).alias("blocking"))
    return pricing.go_no_go(criteria, ["l_orderkey"])


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice * 0.6) AS cost, sum(l_extendedprice * l_tax) AS extra, greatest(0, sum(l_extendedprice * (0.35 - l_discount * 4))) AS profit FROM lineitem GROUP BY 1)
SELECT l_orderkey, u.part, round(u.amount, 4) AS amount, round(CASE WHEN cost + extra + profit = 0 THEN 0 ELSE u.amount / (cost + extra + profit) * 100 END, 6) AS share
FROM s, unnest([{'part': 'cost', 'amount': cost}, {'part': 'extra', 'amount': extra}, {'part': 'profit', 'amount': profit}]) AS t(u)""")
def cost_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return pricing.cost_structure(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"cost": price * 0.6, "extra": price * F.col("l_tax"), "profit": price * (0.35 - F.col("l_discount") * 4)})


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) AS total, coalesce(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'O' AND o_orderpriority < '3')), []) AS gaps FROM orders GROUP BY 1""")
def compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") < "3")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.count("*").alias("total"), F.sort_array(F.collect_list(F.when(gap, F.col("o_orderkey")))).alias("gaps")
    )


# ---- text and matching


@query(r"""WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 4))) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 4))) AS w FROM benchmark),
s AS (SELECT item_id AS need, doc_id AS candidate, count(*) AS relevance FROM b JOIN d USING (w) GROUP BY 1, 2)
SELECT need, candidate, relevance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY need ORDER BY relevance DESC, candidate) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def token_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    return matching.overlap_rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", words, "doc_id", words, 10)


@query(r"""WITH m AS (SELECT doc_id, lang, quality, n_chars, len(list_filter(['license', 'version', 'public', 'apache'], lambda w: contains(lower(coalesce(text, '')), w))) AS k FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(CASE WHEN k = 0 OR lang <> 'en' OR n_chars < 300 THEN 0 ELSE least(100, least(60, k * 12) + CASE WHEN quality = 1 THEN 10 ELSE 0 END + CASE WHEN n_chars >= 1000 THEN 5 ELSE 0 END) END AS INTEGER) AS score FROM m""")
def keyword_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = matching.contract_score(
        F.lower(text.text(F.col("text"))), text.contract_keywords(F.lit("License, version of: public apache?  договору")), [(F.col("quality") == 1, 10), (F.col("n_chars") >= 1000, 5)],
        [~F.col("lang").isin("de", "fr", "es"), F.col("n_chars") >= 300],
    )
    return docs.select("doc_id", score.alias("score"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open FROM orders GROUP BY 1),
m AS (SELECT c_custkey, coalesce(n, 0) AS n, coalesce(open, 0) AS open, c_acctbal, len(list_filter(['build', 'customer', '00042'], lambda w: contains(lower(c_name || ' ' || c_mktsegment), w))) AS k FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CAST(CASE WHEN k = 0 OR c_acctbal < 0 THEN 0 ELSE least(100, least(55, k * 11) + greatest(0, least(15, n)) + CASE WHEN open = 1 THEN 8 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 7 ELSE 0 END) END AS DOUBLE) AS score FROM m""")
def people_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.bool_or(F.col("o_orderstatus") == "O").alias("open"))
    people = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").fillna({"n": 0.0, "open": False})
    score = matching.people_score(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), text.staff_keywords(F.lit("build customer, 00042; build работы")), F.col("n"), [(F.col("open"), 8), (F.col("c_acctbal") > 5000, 7)], [F.col("c_acctbal") >= 0])
    return people.select("c_custkey", score.alias("score"))


ASCII_RULES = [("license", "low", r"licen[cs]e[a-z]*"), ("reserved", "high", r"all rights reserved"), ("contact", "high", r"[a-z0-9.]+@[a-z0-9]+\.example"), ("delay", "high", r"(?:9[0-9]|[1-9][0-9]{2,})\s*(?:days|tage|jours)")]


@query("WITH " + ", ".join(f"r{i} AS (SELECT doc_id, '{a}' AS rule, '{s}' AS severity, regexp_extract(text, '(?i)({p})') AS match FROM documents)" for i, (a, s, p) in enumerate(ASCII_RULES))
       + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(ASCII_RULES))) + ") WHERE match <> ''")
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rule_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ASCII_RULES)


@query("SELECT page_id FROM pages WHERE contains(lower(concat_ws(' ', url, html)), 'track(') ORDER BY page_id LIMIT 200")
def fragment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fragment_search(table(spark, sf_dir, "pages"), [F.col("url"), F.col("html")], "Track(", ["page_id"]).select("page_id")


@query(r"""SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(v)), '["'']', '', 'g'), '[.,;:()\[\]{}-]', ' ', 'g'), ' +', ' ', 'g') AS loose,
trim(regexp_replace(lower(v), '[^\p{L}\p{N}]+', ' ', 'g')) AS strict, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM (SELECT s_suppkey, '  "' || s_name || '" Ltd.' AS v FROM supplier)""")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('  "'), "s_name", F.lit('" Ltd.'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.company_name(name).alias("loose"), text.company_name_strict(name).alias("strict"), text.digits(name).alias("digits"))


@query(r"""SELECT event_id, coalesce(try_cast(replace(replace(regexp_extract(s, '\d[\d\s]*(?:[,.]\d+)?'), ' ', ''), ',', '.') AS DOUBLE), 0) AS number, coalesce(try_cast(regexp_extract(props, '\d+') AS DOUBLE), 0) AS years
FROM (SELECT event_id, props, 'sum ' || (event_id % 7) || ' ' || (100 + event_id % 900) || ',' || (event_id % 10) || ' of ' || props AS s FROM events)""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    spelled = F.concat(F.lit("sum "), key % 7, F.lit(" "), 100 + key % 900, F.lit(","), key % 10, F.lit(" of "), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.number(spelled).alias("number"), text.years(F.col("props")).alias("years"))


@query("""WITH s AS (SELECT r_regionkey AS k, [1 + r_regionkey % 3, 3 + r_regionkey % 3] AS a, 7 AS b FROM region)
SELECT k, list_concat(list_transform(range(a[1], a[2] + 1), lambda x: x - 1), [6]) AS pages, CAST(NULL AS VARCHAR) AS error, 'out-of-range' AS reversed FROM s""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    spec = F.concat((1 + k % 3).cast("string"), F.lit("-"), (3 + k % 3).cast("string"), F.lit(", 7"))
    back = F.concat((3 + k % 3).cast("string"), F.lit("-"), (1 + k % 3).cast("string"))
    out = table(spark, sf_dir, "region").select(k.alias("k"), pages.page_ranges(spec, F.lit(9)).alias("p"), pages.page_ranges(back, F.lit(9)).alias("b"))
    return out.select("k", F.col("p.pages").cast("array<long>").alias("pages"), "p.error", F.col("b.error").alias("reversed"))


@query("SELECT turn AS page, count(*) AS n, min(conv_id) AS first_item, max(conv_id) AS last_item FROM (SELECT conv_id, unnest(t) AS turn FROM (SELECT conv_id, list(turn) AS t FROM conversations GROUP BY 1)) GROUP BY 1")
def invert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("pages"))
    return items.select("conv_id", F.explode("pages").alias("page")).groupBy("page").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_item"), F.max("conv_id").alias("last_item"))


@query("""WITH e AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id AS id, 'k' AS path, json_extract_string(before, '$.k') AS old, json_extract_string(props, '$.k') AS new FROM e WHERE before IS NOT NULL AND json_extract_string(before, '$.k') <> json_extract_string(props, '$.k')""")
def json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("event_id", "props", F.lag("props").over(run).alias("before")).where("before IS NOT NULL")
    return history.diff(history.flatten_json(events, "event_id", "before"), history.flatten_json(events, "event_id", "props"))


# ---- graphs and entities


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, (c_custkey * 7 + 3) % 997 AS parent FROM customer WHERE c_custkey % 5 <> 0 UNION ALL
  SELECT -c_custkey - 1, -p - 1 FROM customer, (VALUES (0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3)) AS x(c, p) WHERE c_custkey = c),
walk(start, node, steps) AS (SELECT child, parent, 1 FROM e UNION SELECT w.start, e.parent, w.steps + 1 FROM walk w JOIN e ON e.child = w.node WHERE w.node <> w.start AND w.steps < 1100)
SELECT DISTINCT start AS node FROM walk WHERE node = start""")
def cycle_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    relations = customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("source"), ((F.col("c_custkey") * 7 + 3) % 997).alias("target"), F.lit("head").alias("type"))
    # two cycles and what lies between them
    joined = F.explode(F.expr("element_at(map(0L, array(1), 1L, array(0, 2), 2L, array(3), 3L, array(4), 4L, array(3)), c_custkey)")).alias("p")
    more = customer.where("c_custkey < 5").select((-F.col("c_custkey") - 1).alias("source"), joined).select("source", (-F.col("p") - 1).cast("long").alias("target"), F.lit("head").alias("type"))
    return graph.on_cycle(graph.parent_edges(relations.unionByName(more)))


@query("""WITH c AS (SELECT c_custkey AS id, 'N' || (c_custkey % 900) AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey % 1100 AS VARCHAR) END AS inn FROM customer),
r AS (SELECT c_custkey AS source, c_custkey * 3 % 1700 AS target, CASE WHEN c_custkey % 31 = 0 THEN 'odd' ELSE 'head' END AS type FROM customer)
SELECT source AS id, 'dangling' AS issue FROM r WHERE target NOT IN (SELECT id FROM c) UNION SELECT source, 'self-link' FROM r WHERE source = target UNION SELECT source, 'unknown-type' FROM r WHERE type = 'odd'
UNION SELECT id, 'repeated-inn' FROM c WHERE inn <> '' AND inn IN (SELECT inn FROM c GROUP BY inn HAVING count(*) > 1)
UNION SELECT id, 'repeated-name' FROM c WHERE name IN (SELECT name FROM c GROUP BY name HAVING count(*) > 1 AND count(DISTINCT CASE WHEN inn <> '' THEN inn END) < count(*))""")
def directory_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    companies = customer.select(key.alias("id"), F.concat(F.lit("N"), key % 900).alias("name"), F.when(key % 4 == 0, "").otherwise((key % 1100).cast("string")).alias("inn"))
    relations = customer.select(key.alias("source"), (key * 3 % 1700).alias("target"), F.when(key % 31 == 0, "odd").otherwise("head").alias("type"))
    return graph.directory_issues(companies, relations)


CARDS = "SELECT c_custkey AS p, c_custkey % 700 AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS inn FROM customer"


@query(f"""WITH c AS ({CARDS}), f AS (SELECT inn, min(p) AS p, arg_min(name, p) AS name FROM c WHERE inn <> '' GROUP BY inn),
t AS (SELECT name, min(p) AS taken FROM f GROUP BY name), o AS (SELECT name, min(p) AS opened FROM c WHERE inn = '' GROUP BY name),
e AS (SELECT f.inn, f.name, f.p, CASE WHEN f.p = t.taken AND o.opened < t.taken THEN o.opened ELSE f.p END AS entity FROM f JOIN t USING (name) LEFT JOIN o USING (name))
SELECT c.p AS "at", coalesce(e.entity, (SELECT arg_max(x.entity, x.p) FROM e x WHERE x.name = c.name AND x.p < c.p), o.opened) AS entity FROM c LEFT JOIN e ON c.inn <> '' AND e.inn = c.inn LEFT JOIN o ON o.name = c.name""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cards = table(spark, sf_dir, "customer").select(key, text.company_name_strict(F.concat(F.lit("Co. "), key % 700)).alias("name"), F.when(key % 3 == 0, "").otherwise((key % 1000).cast("string")).alias("inn"))
    return graph.merge_entities(cards, "name", "inn", "c_custkey")


# ---- one key, or none, with all rows


@query(f"""
WITH e AS (SELECT event_id, ts, {SIGNED} AS amount FROM events),
r AS (SELECT *, sum(amount) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bal FROM e), m AS (SELECT round(least(min(bal), 0), 6) AS lo FROM r)
SELECT (SELECT round(sum(amount), 6) FROM e) AS closing_balance, abs(lo) AS cash_gap, (SELECT min(strftime(ts, '%Y-%m-%d')) FROM r WHERE lo < 0 AND round(bal, 6) = lo) AS gap_date FROM m""")
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.expr(SIGNED).alias("amount"))
    return windows.cash_flow(events, [], ["ts", "event_id"], F.date_format("ts", "yyyy-MM-dd"), hot=True)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS filled_value, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS filled_source
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def ledger_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value", F.col("event_id").alias("source"))
    return windows.forward_fill(events, [], ["ts", "event_id"], F.col("event_type") == "signup", ["value", "source"], hot=True).select("event_id", "filled_value", "filled_source")


@query("""SELECT doc_id, rank, running FROM (SELECT doc_id, CAST(row_number() OVER w AS BIGINT) AS rank, CAST(sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents WINDOW w AS (ORDER BY doc_id DESC)) WHERE rank > 150 OR running > 200000""")
def whole_cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return windows.evict(docs, [], [F.desc("doc_id")], "n_chars", 150, 200_000, hot=True).select("doc_id", F.col("rank").cast("long").alias("rank"), "running")


@query("""SELECT l_orderkey * 10 + l_linenumber AS label, l_returnflag, round(l_extendedprice / greatest(max(l_extendedprice) OVER (PARTITION BY l_returnflag), 1) * 100, 6) AS share,
CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS BIGINT) AS rank FROM lineitem""")
def share_of_few_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"))
    return windows.share_of_max(line, ["l_returnflag"], "l_extendedprice", hot=True).select("label", "l_returnflag", "share", F.col("rank").cast("long").alias("rank"))
