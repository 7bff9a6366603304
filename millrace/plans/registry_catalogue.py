"""Queries of registry order and the company directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import directory, sorting
from millrace.plans.catalogue import query, table

LABELS = """SELECT o_orderkey, o_orderdate, o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN 'Résumé ' WHEN 1 THEN 'resume ' WHEN 2 THEN 'ДОГОВОР ' WHEN 3 THEN 'договор ' ELSE 'Zusatz ' END || (o_orderkey % 1013) AS label,
CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999-12-31' END AS day, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS amount FROM orders"""
# letters of both alphabets in the collation's order: Cyrillic after Latin, or before it, as the collation has it
PLACE = "CAST(row_number() OVER (ORDER BY {by}) AS BIGINT)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("Résumé ", "resume ", "ДОГОВОР ", "договор ", "Zusatz "))), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key, F.concat(kind, (key % 1013).cast("string")).alias("label"), F.when(key % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(key % 11 > 0, F.col("o_totalprice")).alias("amount")
    )


KIND = "CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 2 END"


@query(f"SELECT o_orderkey, label, {PLACE.format(by=f'{KIND}, o_orderkey % 1013, day, o_orderkey')} AS place FROM ({LABELS})")
def sorted_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [sorting.SortKey(F.col("label")), sorting.SortKey(F.col("day"), missing=sorting.NO_DATE)]
    return sorting.placed(_labels(spark, sf_dir), keys, "asc", "o_orderkey").select("o_orderkey", "label", "place")


@query(f"SELECT o_orderkey, label, {PLACE.format(by=f'{KIND} DESC, o_orderkey % 1013 DESC, o_orderkey')} AS place FROM ({LABELS})")
def sorted_by_label_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.placed(_labels(spark, sf_dir), [sorting.SortKey(F.col("label"))], "desc", "o_orderkey").select("o_orderkey", "label", "place")


@query(f"SELECT o_orderkey, amount, {PLACE.format(by='amount DESC NULLS LAST, o_orderkey')} AS place FROM ({LABELS})")
def sorted_by_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.placed(_labels(spark, sf_dir), [sorting.SortKey(F.col("amount"), number=True)], "desc", "o_orderkey").select("o_orderkey", "amount", "place")


@query("""
WITH cards AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'company ' || (c_custkey % 400) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'internal' ELSE 'external' END AS scope, CASE WHEN c_custkey % 2 = 0 THEN 'contracts' ELSE 'manual' END AS source,
  CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE '' END AS contact, c_custkey AS place FROM customer WHERE c_custkey % 3 <> 1),
orders_of AS (SELECT o_orderkey, o_custkey, 'company ' || (o_custkey % 500) AS performer, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS performer_id,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'company ' || (o_orderkey % 450) END AS customer, CASE WHEN o_orderkey % 6 = 0 THEN 'person ' || o_orderkey ELSE '' END AS contact FROM orders),
refs AS (SELECT o_orderkey * 2 AS p, true AS ours, performer AS name, performer_id AS linked, '' AS contact FROM orders_of UNION ALL SELECT o_orderkey * 2 + 1, false, customer, '', contact FROM orders_of WHERE customer <> ''),
by_name AS (SELECT name, arg_max(id, place) AS id FROM cards GROUP BY name),
known AS (SELECT r.*, coalesce(c.id, n.id) AS card FROM refs r LEFT JOIN cards c ON c.id = r.linked LEFT JOIN by_name n ON n.name = r.name),
told AS (SELECT card, bool_or(ours) AS ours, arg_min(contact, p) FILTER (NOT ours AND contact <> '') AS said FROM known WHERE card IS NOT NULL GROUP BY card)
SELECT id, name, CASE WHEN coalesce(ours, false) THEN 'internal' ELSE scope END AS scope, source, CASE WHEN source = 'contracts' AND contact = '' AND said IS NOT NULL THEN said ELSE contact END AS contact, NULL::BIGINT AS added FROM cards LEFT JOIN told ON card = id
UNION ALL SELECT NULL, name, CASE WHEN bool_or(ours) THEN 'internal' ELSE 'external' END, 'contracts', coalesce(arg_min(contact, p) FILTER (NOT ours AND contact <> ''), ''), min(p) FROM known WHERE card IS NULL GROUP BY name""")
def cards_from_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    company = lambda n: F.concat(F.lit("company "), n.cast("string"))
    cards = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 1").select(
        c.alias("id"), company(c % 400).alias("name"), F.when(c % 5 == 0, "internal").otherwise("external").alias("scope"), F.when(c % 2 == 0, "contracts").otherwise("manual").alias("source"), F.when(c % 3 == 0, "own").otherwise("").alias("contact"), c.alias("place")
    )
    contracts = table(spark, sf_dir, "orders").select(
        o, company(F.col("o_custkey") % 500).alias("performer"), F.when(o % 4 == 0, F.col("o_custkey")).alias("performer_id"), F.when(o % 9 == 0, " ").otherwise(company(o % 450)).alias("customer"),
        F.lit(None).cast("string").alias("customer_id"), F.when(o % 6 == 0, F.concat(F.lit(" person "), o.cast("string"))).alias("who"),
    )
    refs = directory.references(contracts, "o_orderkey", "performer", "performer_id", "customer", "customer_id", F.col("who"))
    found = directory.cards_from_contracts(cards, refs, text.company_name)
    return found.select("id", "name", "scope", "source", "contact", (F.col("added.place") * 2 + F.col("added.role")).alias("added"))
