"""Queries of rule checks, calculations, records and imports, with their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import money, pages, text
from millrace.operators import calculation, imports, records, rules
from millrace.plans.catalogue import query, table

#: Keeps sums of money off the halves, where two engines may round apart.
OFF = 0.000013
ORDER = {"O": "Полностью оплачено", "F": "Просрочено", "P": "Не выставлено"}


def today() -> Column:
    return F.to_date(F.lit("1997-06-01"))


# ---- rule checks


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 50 - 5 AS INTEGER) AS e, o_totalprice AS a, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_totalprice * (o_custkey % 11) / 10 END AS p,
  CASE o_orderstatus WHEN 'O' THEN 'Полностью оплачено' WHEN 'F' THEN 'Просрочено' ELSE 'Не выставлено' END AS st, o_custkey % 3 = 0 AS planned, o_custkey % 5 = 0 AS actual, o_orderpriority LIKE '1%' AS acts, o_orderkey % 4 = 0 AS prep FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN e < s THEN 'date-order' END, CASE WHEN p > a THEN 'overpayment' END, CASE WHEN st = 'Полностью оплачено' AND p <= 0 THEN 'paid-zero' END,
  CASE WHEN st = 'Просрочено' AND NOT planned THEN 'overdue-no-date' END, CASE WHEN st = 'Не выставлено' AND actual THEN 'actual-not-issued' END, CASE WHEN acts AND prep THEN 'acts-preparation' END) AS codes FROM o""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_custkey"), F.to_date("o_orderdate")
    contracts = table(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("start_date"), F.date_add(day, (key % 50 - 5).cast("int")).alias("end_date"), F.col("o_totalprice").alias("amount"), F.when(key % 7 == 0, 0.0).otherwise(F.col("o_totalprice") * (key % 11) / 10).alias("paid_amount"),
        F.create_map(*[F.lit(x) for p in ORDER.items() for x in p])[F.col("o_orderstatus")].alias("payment_status"), F.when(key % 3 == 0, day).alias("payment_planned"), F.when(key % 5 == 0, day).alias("payment_actual"),
        F.when(F.col("o_orderpriority").startswith("1"), "Подписаны полностью").alias("acts_status"), F.when(F.col("o_orderkey") % 4 == 0, "Подготовка").alias("stage"),
    )
    return contracts.select("o_orderkey", F.array_join(F.transform(rules.contract_checks(), lambda c: c["code"]), ",").alias("codes"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE 'n' END AS name, CASE WHEN o_custkey % 13 = 0 THEN 0 ELSE o_totalprice END AS nmc, CAST(o_orderdate AS DATE) AS d, o_custkey % 6 - 2 AS lead, 60 + o_custkey % 3 * 25 AS s1, o_orderkey % 2 * 30.5 AS s2,
  CASE WHEN o_orderkey % 5 = 0 THEN 120.0 ELSE 20.0 END AS rate, o_orderstatus = 'F' AS closed FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'Не заполнены название, заказчик или предмет закупки.' END, CASE WHEN nmc <= 0 THEN 'НМЦ должна быть больше нуля.' END,
  CASE WHEN lead > 0 THEN 'Срок вопросов позже срока подачи заявки.' END,
  CASE WHEN s1 + s2 > 100 THEN 'Суммарная доля партнёров ' || CASE WHEN s1 + s2 = floor(s1 + s2) THEN CAST(CAST(s1 + s2 AS BIGINT) AS VARCHAR) ELSE CAST(s1 + s2 AS VARCHAR) END || '% превышает 100%.' END,
  CASE WHEN rate > 100 THEN 'Ставка НДС сценария «Без названия» должна быть от 0 до 100%.' END, CASE WHEN d < DATE '1997-06-01' AND NOT closed THEN 'Срок подачи истёк, но закупка не отмечена как поданная или завершённая.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM o""")
def procurement_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_custkey"), F.to_date("o_orderdate")
    share = lambda v: F.struct(v.cast("double").alias("work_share"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 9 == 0, " ").otherwise("n").alias("name"), F.lit("c").alias("customer"), F.lit("s").alias("subject"), F.when(key % 13 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("nmc"),
        F.date_add(day, (key % 6 - 2).cast("int")).alias("question_deadline"), day.alias("submission_deadline"), F.when(F.col("o_orderstatus") == "F", "Победа").otherwise("Новая").alias("status"),
        F.array(share(60 + key % 3 * 25), share(F.col("o_orderkey") % 2 * 30.5)).alias("partners"), F.array(F.struct(F.lit("").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, 120.0).otherwise(20.0).alias("vat_rate"))).alias("scenarios"),
    )
    return rows.select("o_orderkey", F.array_join(rules.procurement_warnings(today()), "|").alias("warnings"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checklists and requirements of their order, in line order."""
    line = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    entry = F.struct(
        F.col("l_linenumber").alias("at"), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("l_partkey"))).alias("text"), (F.col("l_returnflag") == "A").alias("mandatory"), (F.col("l_linestatus") == "F").alias("done"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("v1").alias("file_version"), F.when(F.col("l_quantity") > 40, "bad").otherwise(" ").alias("validation"),
        F.when(F.col("l_quantity") > 25, "Подтверждено").when(F.col("l_quantity") > 12, "Требует уточнения").otherwise("Не подтверждено").alias("status"), F.when(F.col("l_suppkey") % 2 == 0, " ask ").otherwise("").alias("question"),
        F.array_repeat(F.struct((F.col("l_discount") > 0.05).alias("stale")), (F.col("l_linenumber") % 3).cast("int")).alias("evidence"),
    )
    return line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("checklist")).withColumn("requirements", F.col("checklist"))


LINES = """WITH l AS (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 't' || l_partkey END AS t, l_returnflag = 'A' AS mandatory, l_linestatus = 'F' AS done, l_suppkey % 3 = 0 AS no_file, l_quantity > 40 AS bad,
  CASE WHEN l_quantity > 25 THEN 'yes' WHEN l_quantity > 12 THEN 'ask' ELSE 'no' END AS st, l_suppkey % 2 = 0 AS asks, CASE WHEN l_discount > 0.05 THEN l_linenumber % 3 ELSE 0 END AS stale FROM lineitem)
"""


@query(f"""{LINES}SELECT l_orderkey, count_if(mandatory AND NOT done) AS missing, count_if(done AND (no_file OR bad)) AS invalid_files, CAST(sum(stale) AS BIGINT) AS stale_evidence,
count_if(mandatory AND NOT done) + count_if(done AND (no_file OR bad)) + sum(stale) = 0 AS ready, coalesce(min(CASE WHEN t = '' THEN 'Обязательный пункт без названия' ELSE t END) FILTER (WHERE mandatory AND NOT done), '') AS first_missing FROM l GROUP BY 1""")
def application_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _entries(spark, sf_dir).select("l_orderkey", rules.application_completeness().alias("c"))
    return found.select("l_orderkey", *[F.size(f"c.{x}").cast("long").alias(x) for x in ("missing", "invalid_files", "stale_evidence")], "c.ready", F.coalesce(F.array_min("c.missing"), F.lit("")).alias("first_missing"))


@query(f"""{LINES}SELECT l_orderkey, count_if(st = 'yes') AS confirmed, count(*) AS total, count_if(st <> 'yes') AS gaps, count_if(st <> 'yes') AS open, count_if(st = 'ask' OR asks) AS questions,
coalesce(min(CASE WHEN asks THEN 'ask' ELSE t END) FILTER (WHERE st = 'ask' OR asks), '') AS first_question FROM l GROUP BY 1""")
def compliance_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _entries(spark, sf_dir).select("l_orderkey", rules.compliance().alias("c"), rules.open_requirements().cast("long").alias("open"))
    sizes = [F.col("c.confirmed").cast("long").alias("confirmed"), F.col("c.total").cast("long").alias("total"), F.size("c.gaps").cast("long").alias("gaps"), "open", F.size("c.questions").cast("long").alias("questions")]
    return found.select("l_orderkey", *sizes, F.coalesce(F.array_min("c.questions"), F.lit("")).alias("first_question"))


@query("""
WITH l AS (SELECT l_orderkey, CASE WHEN bool_or(l_suppkey % 2 = 0) THEN 'm' END AS m, CAST(sum(l_quantity) AS BIGINT) AS planned, max(CASE WHEN l_quantity > 45 THEN 1 END) AS heavy FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, date_diff('day', DATE '1997-06-01', CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) - 2 ELSE CAST(o_orderdate AS DATE) END) AS d, o_orderstatus = 'F' AS done, 100 + o_custkey % 80 AS hours FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT done AND d < 0 THEN 'Внутренний срок просрочен' WHEN NOT done AND d <= 3 THEN 'До внутреннего срока ' || d || ' дн.' END, CASE WHEN m IS NULL THEN 'Не назначен менеджер' END,
  CASE WHEN planned < hours THEN 'Не распределено ' || (hours - planned) || ' ч.' END, CASE WHEN heavy = 1 THEN 'Перегрузка сотрудника: 9.0 ч.' END], lambda x: x IS NOT NULL), '|') AS risks FROM o JOIN l ON o_orderkey = l_orderkey""")
def schedule_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = F.struct(F.when(F.col("l_suppkey") % 2 == 0, "Менеджер").otherwise("Эксперт").alias("role"), F.col("l_quantity").alias("planned_hours"), F.when(F.col("l_quantity") > 45, "9.0 ч.").alias("overload"))
    teams = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(assigned).alias("assignments"))
    day = F.to_date("o_orderdate")
    plans = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.date_sub(day, 2)).alias("internal_deadline"), day.alias("submission_deadline"), F.when(F.col("o_orderstatus") == "F", "Подана").otherwise("Новая").alias("status"), (100.0 + F.col("o_custkey") % 80).alias("estimated_hours"))
    return plans.join(teams, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join(rules.schedule_risks(today()), "|").alias("risks"))


@query("""
WITH o AS (SELECT o_custkey, arg_min(CAST(o_orderdate AS DATE), (CAST(o_orderdate AS DATE), o_orderkey)) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '1997-07-31' AND o_orderstatus <> 'P') AS urgent,
  bool_or(o_orderkey % 3 = 0 AND (o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) >= DATE '1997-06-01')) AS edu, bool_or(o_orderkey % 3 = 1 AND (o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) >= DATE '1997-06-01')) AS con,
  bool_or(o_orderkey % 3 = 2 AND (o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) >= DATE '1997-06-01')) AS cer, bool_or(o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01') AS expired FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS own, c_acctbal > 0 AS grade, c_nationkey % 2 = 0 AS skilled, coalesce(edu, false) AS edu, coalesce(con, false) AS con, coalesce(cer, false) AS cer, coalesce(expired, false) AS expired, urgent, o_custkey IS NULL AS bare FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CAST(5 + grade::INT + skilled::INT + edu::INT + con::INT + CASE WHEN own THEN 0 ELSE cer::INT END AS INTEGER) AS met, CAST(CASE WHEN own THEN 9 ELSE 10 END AS INTEGER) AS total,
  concat_ws(',', CASE WHEN NOT grade THEN 'Грейд' END, CASE WHEN NOT skilled THEN 'Навыки' END, CASE WHEN NOT edu THEN 'Диплом' END, CASE WHEN NOT con THEN 'Документ-основание' END, CASE WHEN NOT own AND NOT cer THEN 'Действующий сертификат' END) AS missing,
  coalesce(strftime(urgent, '%Y-%m-%d'), '') AS urgent, expired, bare FROM c""")
def staff_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(F.col("o_orderkey").alias("id"), F.array(F.lit("education"), F.lit("contract"), F.lit("certificate"))[(F.col("o_orderkey") % 3).cast("int")].alias("category"), F.lit("d").alias("name"), F.lit("").alias("type"), (F.col("o_orderstatus") == "P").alias("unlimited"), F.to_date("o_orderdate").alias("expires"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(doc)).alias("documents"))
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("full_name"), F.lit("r").alias("role"), F.when(F.col("c_acctbal") > 0, "g").alias("grade"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("s"))).alias("skills"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Штат").otherwise("Договор ГПХ").alias("basis"), F.lit("").alias("basis_other"), today().alias("start_date"), F.lit("q").alias("qualification"),
    ).join(docs, F.col("c_custkey") == F.col("o_custkey"), "left")
    found = people.select("c_custkey", rules.staff_readiness(today()).alias("r"), rules.urgent_document("documents", today(), 60).alias("u"), rules.any_expiry("documents", "expired", today(), 60).alias("expired"), rules.any_expiry("documents", "no-document", today(), 60).alias("bare"))
    return found.select("c_custkey", "r.met", "r.total", F.array_join("r.missing", ",").alias("missing"), F.coalesce(F.date_format("u.expires", "yyyy-MM-dd"), F.lit("")).alias("urgent"), "expired", "bare")


@query("""
SELECT 'deadline' AS predicate, count_if(date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) + 1 BETWEEN 0 AND 7 AND o_orderstatus <> 'F') AS n FROM orders
UNION ALL SELECT 'overdue', count_if(o_orderstatus = 'O' OR (CAST(o_orderdate AS DATE) < DATE '1997-06-01' AND o_orderstatus <> 'P')) FROM orders
UNION ALL SELECT 'unsigned_acts', count_if(o_custkey % 2 = 0 AND o_custkey % 3 = 0) FROM orders
UNION ALL SELECT 'ending', count_if(date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) + 1 BETWEEN 0 AND 30) FROM orders""")
def dashboard_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, status = F.to_date("o_orderdate"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        day.alias("submission_deadline"), F.when(status == "F", "Победа").otherwise("Новая").alias("status"), F.when(status == "O", "Просрочено").when(status == "P", "Не применяется").otherwise("Выставлено").alias("payment_status"), day.alias("payment_planned"),
        F.when(F.col("o_custkey") % 2 == 0, "Не подписаны").otherwise("Не требуются").alias("acts_status"), F.when(F.col("o_custkey") % 3 == 0, "Закрыт").otherwise("Исполняется").alias("stage"), day.alias("end_date"),
    )
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.dashboard(today()).items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("n")) for n in counts.columns])).alias("p")).select("p.*")


# ---- calculation


def _calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda amount, rate, **more: F.struct(amount.cast("double").alias("amount"), F.lit(float(rate)).alias("vat_rate"), F.lit(True).alias("with_vat"), (F.col("l_linestatus") == "O").alias("payer"), F.lit(True).alias("deductible"), F.lit(True).alias("included"))
    flags = "'with_vat', false, 'payer', false, 'deductible', false, 'included', true"
    expense = lambda kind, value, base, price: F.expr(f"named_struct('enabled', l_returnflag <> 'R', 'kind', '{kind}', 'value', CAST({value} AS double), 'base', '{base}', 'price_base', '{price}', 'custom_base', 1000.0D, 'vat_rate', 0.0D, {flags})")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("proposed_price"), part(F.col("l_extendedprice") * 0.6, 20).alias("cost"), F.array(part(F.col("l_quantity") * 10, 20)).alias("subcontractors"),
        F.array(expense("percent", "5", "contract-price", "gross"), expense("percent", "3", "direct-cost", "net"), expense("percent", "10", "custom", "net"), expense("fixed", "7", "direct-cost", "net")).alias("expenses"),
        F.expr(f"named_struct('present', l_tax > 0.04, 'kind', 'percent', 'value', 2.0D, 'price_base', 'net', 'vat_rate', 0.0D, {flags})").alias("agent"),
        F.expr("named_struct('enabled', l_discount > 0.03, 'rate', 18.0D, 'monthly', false, 'advance', 30.0D, 'delay', 45, 'stages', IF(l_linenumber = 1, array(named_struct('share', 60.0D, 'delay', 30), named_struct('share', 40.0D, 'delay', 90)), array()), 'factoring', 1.0D, 'guarantees', 15.0D, 'reserve', 2.0D)").alias("financing"),
        F.expr("named_struct('enabled', l_linenumber = 2, 'amount', 3.0D, 'rate', IF(l_quantity > 40, 0.0D, 90.0D))").alias("currency"), F.lit(20.0).alias("price_vat_rate"), F.lit(5.0).alias("min_margin"), F.lit(15.0).alias("warning_margin"), F.lit(10.0).alias("target"),
    )


CALCULATION = """
WITH l AS (SELECT *, l_extendedprice * {factor} AS net, l_extendedprice * {factor} * 1.2 AS gross, l_linestatus = 'O' AS payer, l_extendedprice * 0.6 AS c0, l_quantity * 10 AS s0 FROM lineitem{steps}),
d AS (SELECT *, c0 - CASE WHEN payer THEN c0 - c0 / 1.2 ELSE 0 END + s0 - CASE WHEN payer THEN s0 - s0 / 1.2 ELSE 0 END AS direct, CASE WHEN payer THEN c0 - c0 / 1.2 + s0 - s0 / 1.2 ELSE 0 END AS back,
  CASE WHEN l_linenumber = 2 THEN 3 * CASE WHEN l_quantity > 40 THEN 0 ELSE 90 END ELSE 0 END AS cur FROM l),
e AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE gross * 0.05 + direct * 0.03 + 100 + 7 END AS more, CASE WHEN l_tax > 0.04 THEN net * 0.02 ELSE 0 END AS agent,
  CASE WHEN l_discount > 0.03 THEN CASE WHEN l_linenumber = 1 THEN gross * 0.6 * 0.18 * 30 / 365 + gross * 0.4 * 0.18 * 90 / 365 + gross * 0.01 ELSE gross * 0.7 * 0.18 * 45 / 365 + gross * 0.7 * 0.01 END + 15 + (direct + cur) * 0.02 ELSE 0 END AS fin FROM d),
f AS (SELECT *, direct + cur + more + agent + fin AS full_c, net - (direct + cur + more + agent + fin) AS profit, l_linenumber = 2 AND l_quantity > 40 AS bad FROM e)
"""


@query(CALCULATION.format(factor="1", steps="") + """SELECT l_orderkey, l_linenumber, round(direct + 0.000013, 4) AS direct_costs, round(more + 0.000013, 4) AS additional_costs, round(fin + 0.000013, 4) AS financing_cost, round(full_c + 0.000013, 4) AS full_costs, round(profit + 0.000013, 4) AS profit,
round(profit / net * 100 + 0.000013, 4) AS margin, round(profit / full_c * 100 + 0.000013, 4) AS markup, round(gross - net - back + 0.000013, 4) AS vat_payable, NOT bad AS valid, CASE WHEN bad OR profit < 0 OR profit / net * 100 < 5 THEN 'danger' WHEN profit / net * 100 < 15 THEN 'warning' ELSE 'success' END AS status FROM f""")
def calculation_at_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculation.result_at_price(_calculations(spark, sf_dir), F.col("proposed_price"))
    numbers = ("direct_costs", "additional_costs", "financing_cost", "full_costs", "profit", "margin", "markup", "vat_payable")
    return found.select("l_orderkey", "l_linenumber", *[money.rounded(F.col(f"result.{c}") + OFF, 4).alias(c) for c in numbers], "result.valid", "result.status")


@query(CALCULATION.format(factor="(0.8 + step * 0.05)", steps=", range(9) AS t(step)") + """SELECT l_orderkey, round(least(min(profit), 0) + 0.000013, 4) AS low, round(greatest(max(profit), 1) + 0.000013, 4) AS high, round(sum(full_c), 0) AS costs FROM f GROUP BY 1""")
def price_scenario_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculation.price_scenarios(_calculations(spark, sf_dir), F.col("proposed_price")).select("l_orderkey", F.col("result.profit").alias("profit"), F.col("result.full_costs").alias("costs"))
    ranges = calculation.chart_range(found, ["l_orderkey"], "profit", F.round(F.sum("costs"), 0).alias("costs"))
    return ranges.select("l_orderkey", money.rounded(F.col("low") + OFF, 4).alias("low"), money.rounded(F.col("high") + OFF, 4).alias("high"), "costs")


# ---- records and imports


@query("SELECT CAST(greatest(10, least(1000, CAST(json_extract(arg_max(props, (ts, event_id)), '$.k') AS BIGINT) * 20)) AS BIGINT) AS history_limit FROM events WHERE event_type = 'view'")
def history_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct((F.get_json_object("props", "$.k").cast("long") * 20).alias("historyLimit")))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "application").alias("title"), payload.alias("payload"), F.lit(False).alias("archived"), F.struct("ts", "event_id").alias("updated_at"))
    return records.history_limit(rows)


@query("""SELECT l_orderkey, 'p' || l_partkey AS text, min('s' || l_suppkey) AS responsible FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus <> 'F'
AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = lineitem.l_orderkey AND c.l_partkey = lineitem.l_partkey AND c.l_quantity > 40) GROUP BY 1, 2""")
def gap_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("text", F.concat(F.lit("p"), F.col("l_partkey")))
    wanted = line.select("l_orderkey", "text", (F.col("l_returnflag") == "A").alias("mandatory"), F.when(F.col("l_linestatus") == "F", "Подтверждено").alias("status"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("responsible"), F.col("l_shipdate").alias("due"))
    made = records.gap_checklist(wanted, line.where("l_quantity > 40"), "l_orderkey", ["Подтверждено", "Неприменимо"])
    return made.groupBy("l_orderkey", "text").agg(F.min("responsible").alias("responsible"))


@query("""
WITH r AS (SELECT c_custkey AS id, lower(c_name) AS old, 'new ' || c_custkey AS new_name FROM customer WHERE c_nationkey = 7)
SELECT o_orderkey, coalesce(a.new_name, c.c_name) AS performer, coalesce(b.new_name, s.new_name, d.c_name) AS customer, a.id IS NOT NULL OR b.id IS NOT NULL OR s.id IS NOT NULL AS changed
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN customer d ON d.c_custkey = (o.o_custkey + 1) % 10 LEFT JOIN r a ON a.id = o.o_custkey LEFT JOIN r b ON b.id = -1 LEFT JOIN r s ON s.id = d.c_custkey""")
def renamed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    renames = customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" «"), F.upper("c_name"), F.lit("» ")).alias("old_name"), F.concat(F.lit("new "), F.col("c_custkey")).alias("new_name"))
    names = customer.select("c_custkey", "c_name")
    contracts = orders.join(names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("performer"), F.col("c_custkey").alias("performer_id"), ((F.col("o_custkey") + 1) % 10).alias("other"))
    contracts = contracts.join(names, F.col("other") == F.col("c_custkey")).select("o_orderkey", "performer", "performer_id", F.col("c_name").alias("customer"), F.lit(-1).cast("long").alias("customer_id"))
    return records.renamed_company(contracts, renames).select("o_orderkey", "performer", "customer", "changed")


@query("""
WITH n AS (SELECT c_custkey, (c_custkey + 1) AS t1, (c_custkey * 7 + 100000000 * (c_custkey % 2)) AS t2 FROM customer)
SELECT c_custkey AS id, concat_ws('|', 'head: ' || a.c_name, 'branch: ' || b.c_name || ' — main') AS labels FROM n LEFT JOIN customer a ON a.c_custkey = t1 LEFT JOIN customer b ON b.c_custkey = t2""".replace("FROM n LEFT", "FROM (SELECT * FROM n) n LEFT").replace("SELECT c_custkey AS id", "SELECT n.c_custkey AS id"))
def affiliation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda kind, to, note: F.struct(F.lit(kind).alias("type"), to.alias("target"), F.lit(note).alias("note"))
    key = F.col("c_custkey")
    companies = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("name"), F.array(link("head", key + 1, " "), link("branch", key * 7 + 100_000_000 * (key % 2), " main ")).alias("affiliations"))
    return records.affiliation_labels(companies).select("id", F.array_join("labels", "|").alias("labels"))


@query("""
WITH p AS (SELECT o_orderkey AS row, lower('N' || o_custkey % 500) AS name, CAST(o_orderdate AS DATE) AS birth FROM orders), k AS (SELECT DISTINCT 'n' || c_custkey AS name FROM customer WHERE c_acctbal > 5000)
SELECT p.row, p.row > min(p.row) OVER (PARTITION BY p.name, birth) AS repeated, k.name IS NOT NULL AND birth = DATE '1997-06-01' AND p.row % 2 = 0 AS registered FROM p LEFT JOIN k ON k.name = p.name""")
def repeated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("o_orderkey") % 2 == 1, " ").otherwise("")
    people = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.concat(F.lit("N"), F.col("o_custkey") % 500, blank).alias("name"), F.to_date("o_orderdate").alias("birth"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("n"), F.col("c_custkey")).alias("name"), today().alias("birth"))
    return records.repeated_people(people, known).select("row", "repeated", "registered")


@query("SELECT DISTINCT o_custkey AS id, 'f' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'F') AND o_orderkey % 3 > 0")
def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(F.col("o_orderstatus").alias("category"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("f"), F.col("o_orderkey"))).alias("path"))
    people = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(doc).alias("documents"))
    return records.document_paths(people, table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")), ["O", "F"])


@query("""
WITH f AS (SELECT o_orderkey AS name, o_orderdate AS modified FROM orders WHERE o_orderkey % 17 > 0), k AS (SELECT * FROM f ORDER BY modified DESC, name DESC LIMIT 50)
SELECT name FROM f WHERE name NOT IN (SELECT name FROM k WHERE modified >= TIMESTAMP '1998-01-01')""")
def backup_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("modified"))
    return records.rotation(files, files.where("name % 17 = 0"), 50, F.to_timestamp(F.lit("1998-01-01"))).select("name")


@query("""
WITH v AS (SELECT o_custkey AS document, max(o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o.o_orderkey AS version, CAST(CASE WHEN o.o_orderkey % 5 = 0 THEN '7' ELSE CAST(v.last AS VARCHAR) END AS VARCHAR) AS supersedes FROM orders o LEFT JOIN v ON v.document = o.o_custkey
WHERE o.o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus <> 'P' AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority)""")
def new_document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderpriority").alias("sha256"), F.when(F.col("o_orderkey") % 5 == 0, "7").otherwise("").alias("supersedes"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    made = records.new_versions(every.where("o_orderstatus <> 'P'").select("document", "version", "sha256", "place"), every.where("o_orderstatus = 'P'").drop("o_orderstatus"))
    return made.select(F.col("version").cast("long").alias("version"), "supersedes")


@query("""
SELECT CAST(o_orderkey + 2 AS BIGINT) AS row, CASE WHEN o_custkey % 4 = 0 THEN 'Договор' ELSE o_orderpriority END AS basis, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'other' END AS status, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 1 ELSE 0 END AS n_issues FROM orders""")
def mapped_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("o_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    sheet = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.array(F.lit("x"), basis, F.col("o_orderstatus")).alias("cells"))
    found = imports.mapped_rows(sheet, {"basis": 1, "status": 2, "notes": 9}, ["basis", "status", "notes"], {"basis": "Договор"}, {"status": (["O", "F"], "other")})
    return found.select("row", "basis", "status", F.size("issues").alias("n_issues"))


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders), e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE s END AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE p END AS p, s AS s0, p AS p0 FROM b)
SELECT o_orderkey AS row, s, p, CAST((s <> s0) AS INTEGER) + CAST((p IS DISTINCT FROM p0) AS INTEGER) AS n_patches FROM e""")
def import_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    edited = rows.select("row", F.when(F.col("row") % 3 == 0, "X").otherwise(F.col("s")).alias("s"), F.when(F.col("row") % 4 != 0, F.col("p")).alias("p"))
    found = imports.patches(rows, edited)
    counts = found.groupBy("row").agg(F.count("*").cast("int").alias("n_patches"))
    return imports.patched(rows, found).join(counts, "row", "left").select("row", "s", "p", F.coalesce("n_patches", F.lit(0)).alias("n_patches"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders""")
def merged_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = previous.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), F.lit("x").alias("o_orderpriority"))
    return imports.merged_update(previous, new, "o_orderkey", {"status": 0, "price": 3, "priority": -1}, {"status": ["o_orderstatus"], "price": ["o_totalprice"], "priority": ["o_orderpriority"]})


# ---- small functions


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size AS file_name, lower(p_name) || ' ' || p_size AS block_name, coalesce(CASE WHEN p_size % 10 = 0 THEN 'unusable-name' END, CASE WHEN p_size % 7 = 0 THEN 'repeated-name' END, '') AS errors FROM part""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.translate("p_name", " ", "%")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", text.safe_file_name(F.concat(base, F.lit("/"), F.col("p_size"))).alias("file_name"), text.block_name(F.concat(F.lit(" "), F.lower(F.translate("p_name", " ", "?")), F.lit(' <> '), F.col("p_size"), F.lit("..PDF"))).alias("block_name"))
    block = lambda name: F.struct(F.lit("b").alias("name"), name.alias("file_name"))
    second = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 7 == 0, "ONE").otherwise("two")
    return part.select("p_partkey", "file_name", "block_name", F.array_join(pages.block_errors(F.array(block(F.lit("one")), block(second))), ",").alias("errors"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, ((l_partkey * 1664525 + CAST(l_linenumber AS BIGINT) * 1013904223) & 4294967295) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(xor(v, v >> 16) / 4294967295.0, 9) AS jitter FROM m""")
def page_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round(pages.page_jitter(F.col("l_partkey"), F.col("l_linenumber") - 1), 9).alias("jitter"))
