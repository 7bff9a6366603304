"""The company directory from contracts: cards that are missing are added, others learn what the contracts say.

Contracts are taken in their order, the performing company before the customer. A company is known by the id that the
contract holds, else by its name. Which cards come out depends on the order only through first places, which are
aggregates: no window, and no group holds the contracts of a company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text


def references(contracts: DataFrame, place: str, performer: str, performer_id: str, customer: str, customer_id: str, contact: Column) -> DataFrame:
    """(at, ours, name, linked, contact) of both companies of every contract; blank names are left out."""
    clean = lambda c: F.trim(text(c if isinstance(c, Column) else F.col(c)))
    own = F.struct(F.struct(F.col(place).alias("place"), F.lit(0).alias("role")).alias("at"), F.lit(True).alias("ours"), clean(performer).alias("name"), text(F.col(performer_id).cast("string")).alias("linked"), F.lit("").alias("contact"))
    other = F.struct(F.struct(F.col(place).alias("place"), F.lit(1).alias("role")).alias("at"), F.lit(False).alias("ours"), clean(customer).alias("name"), text(F.col(customer_id).cast("string")).alias("linked"), clean(contact).alias("contact"))
    return contracts.select(F.inline(F.array(own, other))).where("name <> ''")


def cards_from_contracts(cards: DataFrame, refs: DataFrame, name_key) -> DataFrame:
    """The cards (id, name, scope, source, contact, place) after the references, and the new ones: (id, name, scope, source,
    contact, added, changed).

    A company of ours becomes internal. A contact is filled in where it is blank, by the first one of a customer, and
    only on cards that came from contracts. A new card has no id; its name is as it was first met, and `added` is its
    number in the order of first meetings, by (place, role). name_key normalises a name; of cards with one name the last
    is meant, and a link to no card counts for nothing.
    """
    cards = cards.withColumn("key", name_key(F.col("name"))).withColumn("id", F.col("id").cast("string"))
    named = cards.groupBy("key").agg(F.max_by("id", "place").alias("by_name"))
    known = refs.withColumn("key", name_key(F.col("name"))).join(cards.select(F.col("id").alias("linked"), F.col("id").alias("by_link")), "linked", "left").join(named, "key", "left")
    known = known.withColumn("card", F.coalesce("by_link", "by_name"))
    said = [F.max("ours").alias("ours"), F.coalesce(F.min_by("contact", F.when(~F.col("ours") & (F.col("contact") != ""), F.col("at"))), F.lit("")).alias("told")]

    of_cards = known.where("card IS NOT NULL").groupBy(F.col("card").alias("id")).agg(*said)
    both = cards.join(of_cards, "id", "left")
    raised = F.coalesce(F.col("ours"), F.lit(False)) & (F.col("scope") != "internal")
    filled = (F.col("source") == "contracts") & (F.trim(text(F.col("contact"))) == "") & (F.coalesce("told", F.lit("")) != "")
    kept = both.select(
        "id", "name", F.when(raised, "internal").otherwise(F.col("scope")).alias("scope"), "source", F.when(filled, F.col("told")).otherwise(F.col("contact")).alias("contact"),
        F.lit(None).cast(refs.schema["at"].dataType).alias("added"), (raised | filled).alias("changed"),
    )
    new = known.where("card IS NULL").groupBy("key").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("added"), *said)
    new = new.select(
        F.lit(None).cast("string").alias("id"), "name", F.when(F.col("ours"), "internal").otherwise("external").alias("scope"), F.lit("contracts").alias("source"), F.col("told").alias("contact"), "added", F.lit(True).alias("changed"),
    )
    return kept.unionByName(new)
