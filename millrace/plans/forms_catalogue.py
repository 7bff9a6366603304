"""Queries of form fields, dates, pages and stored records."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, money, pages, text
from millrace.operators import history, records, reports, rules, sorting
from millrace.plans.catalogue import query, table
from millrace.sources import calculations
from millrace.streaming import job_states

# ---- dates


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('week', date_trunc('month', o_orderdate)), '%Y-%m-%d') AS first_day, strftime(date_trunc('week', date_trunc('month', o_orderdate)) + INTERVAL 41 DAY, '%Y-%m-%d') AS last_day, 42 AS days FROM orders")
def month_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).distinct()
    grid = months.withColumn("grid", dates.month_grid(F.col("month")))
    ends = [F.date_format(F.element_at("grid", i), "yyyy-MM-dd").alias(c) for i, c in ((1, "first_day"), (-1, "last_day"))]
    return grid.select(F.date_format("month", "yyyy-MM").alias("month"), *ends, F.size("grid").alias("days"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE '' END AS day,
CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 4 = 2 AND month(o_orderdate) = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period_end, o_orderkey % 4 = 3 OR o_orderkey % 4 = 2 AND month(o_orderdate) = 1 AS lasts FROM orders""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    named = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(day))
    written = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.concat(F.lit("от "), F.date_format(day, "dd.MM.yyyy"), F.lit(" г."))).when(key % 4 == 2, F.concat(F.lit("с "), named, F.lit(" "), F.year(day).cast("string"))).otherwise("по н.в.")
    end = dates.period_end(written)
    return table(spark, sf_dir, "orders").select(key, dates.any_date(written).alias("day"), F.date_format(end["end"], "yyyy-MM-dd").alias("period_end"), end["open"].alias("lasts"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber = 4 AS unlimited, CASE l_linenumber WHEN 4 THEN '' WHEN 5 THEN '' WHEN 3 THEN '2027-12-31' WHEN 6 THEN '' ELSE '20' || strftime(l_shipdate, '%y-%m-%d') END AS expires FROM lineitem""")
def certificate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, short = F.col("l_linenumber"), lambda p: F.date_format("l_shipdate", p)
    written = F.when(n == 1, F.concat(F.lit("до 20"), short("yy-MM-dd"))).when(n == 2, F.concat(F.lit("до "), short("dd.MM."), F.lit("20"), short("yy"))).when(n == 3, "2027 год").when(n == 4, "Бессрочно с 2020").when(n == 5, "нет").when(n == 6, "12027").otherwise(F.concat(F.lit("(20"), short("yy-MM-dd"), F.lit(")")))
    found = dates.certificate_validity(written)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found["unlimited"].alias("unlimited"), found["expires"].alias("expires"))


@query("SELECT event_id, coalesce(event_id % 50 > 0 AND ts + to_hours(event_id % 50) <= TIMESTAMP '2024-01-20', false) AS due FROM events")
def backups_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.backup_due(F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"), F.col("event_id") % 50).alias("due"))


# ---- contacts and texts


@query("""SELECT c_custkey, 'mail' || c_custkey || '@firm.ru' AS email, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+7 (495) 123-45-' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') END AS phone,
CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 3 END AS n_entries, c_custkey % 5 = 0 AS agrees, CASE WHEN c_custkey % 7 = 0 THEN 'none' WHEN c_custkey % 2 = 0 THEN c_name || ' · ' || c_mktsegment ELSE c_name END AS summary,
c_custkey % 6 IN (0, 1) AS travels FROM customer""")
def contact_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, two = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 2, "0")
    phone = F.when(key % 3 == 0, "8-800").otherwise(F.concat(F.lit("+7 (495) 123-45-"), two(key % 90 + 10)))
    contact = F.concat(F.col("c_name"), F.lit("; mail"), key.cast("string"), F.lit("@firm.ru, тел. "), phone, F.lit(" офис"))
    listed = F.concat(F.lit("один;\r\n два "), F.when(key % 4 == 0, ";Не указано").otherwise("\nтри"))
    answers = F.element_at(F.array(*map(F.lit, ("Да, готов", "люблю поездки", "не готов", "Невозможно", "нет", ""))), (key % 6 + 1).cast("int"))
    blank = F.when(key % 7 == 0, " ")
    summary = text.summary([F.coalesce(blank, F.col("c_name")), F.when(key % 2 == 0, F.coalesce(blank, F.col("c_mktsegment")))], F.lit("none"))
    return table(spark, sf_dir, "customer").select(
        key, text.email(contact).alias("email"), text.phone(contact).alias("phone"), F.size(text.entries(listed)).alias("n_entries"),
        text.is_yes(F.when(key % 5 == 0, " ДА ").otherwise("да нет")).alias("agrees"), summary.alias("summary"), text.travel_ready(answers).alias("travels"),
    )


@query("""SELECT page_id, lower(to_hex(list_reduce(list_prepend(2166136261, list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) AS hash FROM pages WHERE url <> ''""")
def url_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("url <> ''").select("page_id", text.fnv1a(F.col("url")).alias("hash"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'ok' WHEN c_custkey % 4 = 2 THEN 'warning' ELSE 'error' END AS email_state, greatest(0, round(c_acctbal - 1000, 6)) AS outstanding, greatest(0, round(1000 - c_acctbal, 6)) AS overpayment FROM customer""")
def contact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    address = F.when(key % 4 == 0, " ").when(key % 4 == 1, F.concat(F.lit("a.b"), key.cast("string"), F.lit("@firm.ru"))).otherwise(F.concat(F.lit("wrong@@"), key.cast("string")))
    due = money.balance(F.col("c_acctbal"), F.lit(1000.0))
    return table(spark, sf_dir, "customer").select(key, rules.email_state(address, F.when(key % 4 == 2, address)).alias("email_state"), F.round(due["outstanding"], 6).alias("outstanding"), F.round(due["overpayment"], 6).alias("overpayment"))


# ---- pages and words


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 6000 AS pages, 100.0 * l_quantity AS w, 80.0 * l_quantity AS h, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_suppkey + 1 END AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN size < 1 OR size > 1073741824 THEN 'size' END, CASE WHEN pages < 1 OR pages > 5000 THEN 'pages' END, CASE WHEN (w / 72 * 600) * (h / 72 * 600) > 180e6 THEN 'pixels' END) AS beyond,
round((1 - pages / greatest(1, size)) * 100, 6) AS savings FROM l""")
def render_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 6000).alias("pages"), (F.col("l_quantity") * 100.0).alias("w"), (F.col("l_quantity") * 80.0).alias("h"), F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_suppkey") + 1).alias("size"))
    beyond = rules.render_budget(F.col("pages"), F.col("w"), F.col("h"), F.lit(600), F.col("size"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(beyond, ",").alias("beyond"), F.round(rules.savings_percent(F.col("size"), F.col("pages")), 6).alias("savings"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, least(0.99, greatest(0, l_discount * 12)) AS x, least(0.99, greatest(0, l_tax * 10 - 0.1)) AS y, l_quantity / 40 AS w0, 0.001 AS h0 FROM lineitem),
p AS (SELECT *, least(1 - x, greatest(0.01, w0)) AS w, least(1 - y, greatest(0.01, h0)) AS h FROM l)
SELECT l_orderkey, l_linenumber, round(least(1 - w, greatest(0, x + 0.3)), 6) AS x, round(least(1 - h, greatest(0, y - 0.3)), 6) AS y, round(w, 6) AS width, round(h, 6) AS height FROM p""")
def moved_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = F.struct((F.col("l_discount") * 12).alias("x"), (F.col("l_tax") * 10 - 0.1).alias("y"), (F.col("l_quantity") / 40).alias("width"), F.lit(0.001).alias("height"))
    moved = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pages.moved_rect(rect, F.lit(0.3), F.lit(-0.3)).alias("r"))
    return moved.select("l_orderkey", "l_linenumber", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("x", "y", "width", "height")])


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity * 2.0 AS c FROM lineitem WHERE l_quantity * 2.0 >= 20)
SELECT o_orderkey AS l_orderkey, round(coalesce(avg(c), 0), 6) AS mean, count(*) FILTER (c < 50) AS n_low FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN w ON l_orderkey = o_orderkey GROUP BY 1""")
def word_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.struct(F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") * 2.0).alias("confidence"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(word)).alias("words"))
    found = rules.word_confidence("words")
    return lines.select("l_orderkey", F.round(found["mean"], 6).alias("mean"), F.size(found["low"]).cast("long").alias("n_low"))


# ---- records


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    payload = F.to_json(F.struct(F.concat(F.lit("attachments/"), (key % 50).cast("string"), F.lit(".pdf")).alias("relativePath"), F.struct(F.when(key % 3 == 0, F.concat(F.lit("other/"), key.cast("string"))).alias("relativePath")).alias("more")))
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderstatus").alias("module"), F.concat(F.lit("t"), (key % 40).cast("string")).alias("title"), payload.alias("payload"), (key % 5 == 0).alias("archived"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))


@query("SELECT o_orderkey AS id, 't' || (o_orderkey % 40) AS title FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0")
def module_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.list_records(_records(spark, sf_dir), "F").select("id", "title")


@query("SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS archived FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey % 10 = 0 DESC, o_orderdate DESC, o_orderkey DESC LIMIT 1")
def prioritised_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("module = 'O'")
    return records.prioritised(rows, F.col("id") % 10 == 0, "updated_at").select("id", "archived")


@query("SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS archived FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 5 = 0)")
def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    last = rows.where("archived").agg(F.max("id")).first()[0]
    return records.lookup(rows, id=last).select("id", "archived")


@query("SELECT DISTINCT 'attachments/' || (o_orderkey % 50) || '.pdf' AS path FROM orders")
def attachment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.paths_in(history.flatten_json(_records(spark, sf_dir), "id", "payload"))


@query("SELECT o_orderkey AS id, 'x' || (o_orderkey % 30) AS path FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AND o_orderkey % 4 > 0")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    files = rows.select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("x"), (F.col("id") % 30).cast("string"))).otherwise(" ").alias("path"))
    kept, _ = records.registry_archive(rows, rows.where("id % 7 = 0"), files, None)
    return kept.join(files, "id").where("trim(path) <> ''").select("id", "path")


@query("SELECT l_orderkey, l_linenumber, 't' || (l_orderkey % 40) AS title, '2026-01-01' AS captured_at FROM lineitem WHERE l_linenumber = 1")
def linked_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("source_id"))
    found = records.snapshots(links, _records(spark, sf_dir), F.lit("2026-01-01"))
    return found.select("l_orderkey", "l_linenumber", "snapshot.title", "snapshot.captured_at")


@query("""SELECT l_orderkey, coalesce(arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_quantity > 45), arg_min(l_partkey, (l_linenumber, l_partkey))) AS part FROM lineitem GROUP BY 1""")
def primary_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("l_linenumber", F.col("l_partkey").alias("part"), (F.col("l_quantity") > 45).alias("is_primary"))
    people = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("assignments"))
    none = F.lit(None).cast("struct<l_linenumber: int, part: bigint, is_primary: boolean>")
    return people.select("l_orderkey", records.primary_assignment("assignments", none)["part"].alias("part"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT (SELECT count(*) FROM customer) AS people, (SELECT sum(n) FROM n)::BIGINT AS documents, (SELECT count(*) FROM n) AS people_with_documents""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("documents"))
    people = table(spark, sf_dir, "customer").select("c_custkey").join(files, "c_custkey", "left")
    return rules.nested_counts(people, "documents", "people", "people_with_documents")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC LIMIT 20")
def load_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.ranked_positive(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 20)


JOB_EVENT = "CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'recover' WHEN 'purchase' THEN 'finish' ELSE 'cancel' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id * 1000 + date_diff('day', TIMESTAMP '2024-01-01', ts) AS job, ts, event_id, {JOB_EVENT} AS ev FROM events),
o AS (SELECT job, ts, ev, row_number() OVER (PARTITION BY job ORDER BY ts, ev) AS n FROM e),
step(job, n, status, refused) AS (SELECT job, 0::BIGINT, NULL::VARCHAR, 0::BIGINT FROM (SELECT DISTINCT job FROM o)
UNION ALL SELECT s.job, o.n, CASE WHEN ev = 'queue' AND status IS NULL THEN 'queued' WHEN ev = 'start' AND status IN ('queued', 'interrupted') THEN 'running' WHEN ev = 'finish' AND status = 'running' THEN 'succeeded'
  WHEN ev = 'cancel' AND status IN ('queued', 'running', 'interrupted') THEN 'cancelled' WHEN ev = 'recover' AND status = 'running' THEN 'interrupted' ELSE status END,
  refused + CASE WHEN ev = 'queue' AND status IS NULL OR ev = 'start' AND status IN ('queued', 'interrupted') OR ev = 'finish' AND status = 'running' OR ev = 'cancel' AND status IN ('queued', 'running', 'interrupted') OR ev = 'recover' AND status = 'running' THEN 0 ELSE 1 END
  FROM step s JOIN o ON o.job = s.job AND o.n = s.n + 1)
SELECT CAST(job AS VARCHAR) AS job, arg_max(coalesce(status, ''), n) AS status, max(refused) AS n_refused FROM step WHERE n > 0 GROUP BY job""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.datediff("ts", F.lit("2024-01-01"))).alias("job"), F.col("ts").cast("timestamp").alias("at"), F.expr(JOB_EVENT).alias("event"))
    found = job_states.latest(job_states.folded(events, timedelta(days=400)))
    return found.select("job", F.coalesce("status", F.lit("")).alias("status"), "n_refused")


@query("""WITH o AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Подана' WHEN 1 THEN 'Приостановлена' ELSE 'В работе' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS i, (o_orderdate + INTERVAL 3 DAY)::DATE AS d, o_orderkey % 4 AS r FROM orders),
s AS (SELECT count(*) FILTER (status = 'В работе') AS active, count(*) FILTER (status = 'В работе' AND coalesce(i, d) - DATE '1998-01-01' <= 5) AS urgent, count(*) FILTER (status = 'В работе' AND r NOT IN (1, 2)) AS without_manager FROM o)
SELECT *, (SELECT count(*) FROM customer WHERE c_acctbal / 50 > 100 OR c_custkey % 6 = 0) AS overloaded FROM s""")
def calendar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    roles = F.when(key % 4 == 1, F.array(F.lit("Юрист"), F.lit("Менеджер"))).when(key % 4 == 2, F.array(F.lit("Руководитель заявки"))).when(key % 4 == 3, F.array(F.lit("Юрист")))
    schedules = table(spark, sf_dir, "orders").select(
        F.when(key % 5 == 0, "Подана").when(key % 5 == 1, "Приостановлена").otherwise("В работе").alias("status"), F.when(key % 3 > 0, F.to_date("o_orderdate")).alias("internal_deadline"), F.date_add(F.to_date("o_orderdate"), 3).alias("submission_deadline"), roles.alias("roles")
    )
    loads = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 50).alias("load_percent"), F.when(F.col("c_custkey") % 6 == 0, 2).otherwise(0).alias("conflicts"))
    return rules.calendar_stats(schedules, loads, F.lit("1998-01-01").cast("date"))


@query("SELECT o_orderkey, round(o_totalprice - 200000, 4) AS profit, round((o_totalprice - 200000) / o_totalprice * 100, 4) AS margin FROM orders WHERE o_totalprice > 0")
def actual_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.actual_result(F.col("o_totalprice"), F.lit(200_000.0))
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", F.round(found["profit"], 4).alias("profit"), F.round(found["margin"], 4).alias("margin"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_errors, CASE WHEN o_orderkey % 7 = 0 THEN 1000000.0 ELSE round(o_totalprice, 4) END AS cost,
CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n_expenses, o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 AS financed, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 THEN 18.0 ELSE 0.0 END AS rate FROM orders""".replace("CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END", "CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END"))
def imported_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    listed = F.when(key % 5 == 0, '"none"').otherwise('[{"name": "x", "type": "percent", "value": 5}]')
    written = F.format_string('{"cost": %.2f, "expenses": %s, "paymentRiskEnabled": %s, "paymentRiskPercent": 1.5}', F.col("o_totalprice"), listed, F.when(key % 3 == 0, "true").otherwise("false"))
    files = table(spark, sf_dir, "orders").select(key, F.when(key % 7 == 0, "[1, 2]").otherwise(written).alias("content"))
    found = calculations.calculations(files)
    return found.select("o_orderkey", F.size("errors").alias("n_errors"), F.round("cost.amount", 4).alias("cost"), F.size("expenses").alias("n_expenses"), F.col("financing.enabled").alias("financed"), F.col("financing.rate").cast("decimal(3,1)").alias("rate"))


@query("""WITH r AS (SELECT l_orderkey, string_agg('<tr><td>p&amp;' || l_partkey || '</td><td>' || l_shipmode || '</td><td>' || CAST(l_quantity AS INTEGER) || '</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_quantity) AS b, sum(l_quantity) AS t FROM (SELECT *, 'mode' AS l_shipmode FROM lineitem) GROUP BY 1)
SELECT l_orderkey, '<h2>Распределение работ</h2><table><tr><th>Участник</th><th>Роль</th><th>Доля, %</th><th>Зона ответственности</th></tr>' || b || '<tr><td colspan="2"><b>Итого</b></td><td><b>' || CAST(t AS INTEGER) || '%</b></td><td>' || CASE WHEN t > 100 THEN '<span class="warn">Доля превышает 100%</span>' ELSE '' END || '</td></tr></table>' AS body FROM r""")
def work_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("p&"), F.col("l_partkey").cast("string")).alias("name"), F.lit("mode").alias("role"), F.col("l_quantity").alias("work_share"), F.col("l_returnflag").alias("responsibility"))
    gathered = reports.listed(line, "l_orderkey", ["l_linenumber", "l_partkey", "work_share"], ["name", "role", "work_share", "responsibility"], "partners")
    return gathered.select("l_orderkey", reports.work_allocation(F.col("partners")).alias("body"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'same-computer' ELSE 'local-network' END AS mode, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://h' WHEN 2 THEN 'unix://s' WHEN 3 THEN 'https://u@h' ELSE 'http://h' END AS e,
o_orderkey % 31 = 0 AS redirects, o_orderkey % 700 AS timeout, o_orderkey % 6 AS jobs, o_orderkey % 2 AS secret, o_orderkey % 7 AS print FROM orders)
SELECT o_orderkey, CASE WHEN redirects THEN 'Автоматические перенаправления запрещены' WHEN timeout NOT BETWEEN 5 AND 600 THEN 'Таймаут должен быть от 5 до 600 секунд' WHEN jobs NOT BETWEEN 1 AND 4 THEN 'Допускается от 1 до 4 параллельных заданий'
WHEN e IS NULL AND mode = 'disabled' THEN NULL WHEN e IS NULL THEN 'Для выбранного режима требуется адрес сервера' WHEN e LIKE '%@%' THEN 'Адрес не должен содержать учётные данные или fragment' WHEN mode = 'disabled' THEN 'У выключенного провайдера не должно быть адреса'
WHEN mode = 'same-computer' AND e NOT LIKE 'unix%' THEN 'Для сервера на этом компьютере используйте Unix socket или Windows Named Pipe' WHEN mode = 'local-network' AND e NOT LIKE 'https://%' THEN 'Для сервера в локальной сети разрешён только HTTPS'
WHEN mode = 'local-network' AND secret = 0 THEN 'Секрет должен храниться в системном хранилище учётных данных' WHEN mode = 'local-network' AND print = 0 THEN 'Нужно закрепить сертификат локального сервера' END AS error FROM o""")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    error = rules.provider_error(
        pick(3, "disabled", "same-computer", "local-network"), pick(5, None, "https://h", "unix://s", "https://u@h", "http://h"), key % 31 == 0, key % 700, key % 6, F.when(key % 2 == 1, "s"), F.when(key % 7 > 0, "f")
    )
    return table(spark, sf_dir, "orders").select(key, error.alias("error"))
