"""Graph and entity operators: directory checks, cycles of parents, order-dependent merging."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.scan import running
from millrace.shared import saved


def parent_edges(relations: DataFrame) -> DataFrame:
    """(child, parent) from (source, target, type): a head is the parent, a subsidiary or branch the child."""
    up = F.col("type") == "head"
    return relations.where(F.col("type").isin("head", "subsidiary", "branch")).select(
        F.when(up, F.col("source")).otherwise(F.col("target")).alias("child"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("parent")
    ).distinct()


def on_cycle(edges: DataFrame) -> DataFrame:
    """(node) of the nodes that lie on a cycle of (child, parent).

    Nodes without parents or without children are peeled off. Of what is left every node has a parent; each takes its
    least one, and the nodes that such walks come to after at least as many steps as there are nodes are the cycles of
    those choices, found by doubling the length of the steps. Each cycle becomes one node, and all is repeated with
    the other edges until none are left. Rounds grow with the depth of what is peeled and the logarithm of a cycle.
    """
    edges = edges.where("child IS NOT NULL AND parent IS NOT NULL")
    found = _cut(edges.where("child = parent").select(F.col("child").alias("node")).distinct())
    left = _cut(edges.where("child <> parent").distinct())
    while not (left := _peeled(left)).isEmpty():
        step = left.groupBy("child").agg(F.min("parent").alias("to"))
        walk = _cut(step.select(F.col("child").alias("node"), "to", F.least("child", "to").alias("low")))
        for _ in range(walk.count().bit_length()):
            ahead = walk.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
            walk = _cut(walk.join(ahead, "to").select("node", F.col("_to").alias("to"), F.least("low", "_low").alias("low")))
        ring = _cut(walk.join(walk.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", "low"))
        found = _cut(found.unionByName(ring.select("node")).distinct())
        into = [ring.select(F.col("node").alias(c), F.col("low").alias(f"_{c}")) for c in ("child", "parent")]
        ends = left.join(into[0], "child", "left").join(into[1], "parent", "left").select(F.coalesce("_child", "child").alias("child"), F.coalesce("_parent", "parent").alias("parent"))
        left = _cut(ends.where("child <> parent").distinct())
    return found


def _peeled(left: DataFrame) -> DataFrame:
    """The edges that stay when nodes without parents or without children have gone, again and again."""
    now, before = left.count(), -1
    while now not in (0, before):
        parents, children = left.select(F.col("parent").alias("child")).distinct(), left.select(F.col("child").alias("parent")).distinct()
        left = _cut(left.join(parents, "child", "left_semi").join(children, "parent", "left_semi").select("child", "parent"))
        now, before = left.count(), now
    return left


def _cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared folder; only a local master may go without one."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def directory_issues(companies: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, issue): dangling targets, self-links, unknown types, repeated relations, contradictory roles (different
    structural types to one company), and repeated names or INNs.

    companies: (id, name, inn); relations: (source, target, type). A repeated name is no issue if both INNs differ.
    """
    ids = companies.select(F.col("id").alias("_id"))
    issue = lambda df, col, name: df.select(F.col(col).alias("id"), F.lit(name).alias("issue"))
    out = [
        issue(relations.join(ids, F.col("target") == F.col("_id"), "left_anti"), "source", "dangling"),
        issue(relations.where("source = target"), "source", "self-link"),
        issue(relations.where(~F.col("type").isin("head", "subsidiary", "branch", "partner", "other")), "source", "unknown-type"),
        issue(relations.groupBy("source", "target", "type").count().where("count > 1"), "source", "repeated-relation"),
    ]
    structural = relations.where("type IN ('head', 'subsidiary', 'branch')").join(ids, F.col("target") == F.col("_id"), "left_semi")
    out.append(issue(structural.groupBy("source", "target").agg(F.min("type").alias("lo"), F.max("type").alias("hi")).where("lo <> hi"), "source", "contradictory-role"))
    inns = companies.where("inn <> ''").groupBy("inn").agg(F.count("*").alias("n")).where("n > 1").select("inn")
    out.append(issue(companies.join(inns, "inn", "left_semi"), "id", "repeated-inn"))
    # of one name, all INNs known and different is fine
    names = companies.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("inn") != "", F.col("inn"))).alias("inns")).where("n > 1 AND inns < n").select("name")
    out.append(issue(companies.join(names, "name", "left_semi"), "id", "repeated-name"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def merge_entities(companies: DataFrame, name_key: str, inn: str, order: str) -> DataFrame:
    """(order, entity): cards merged in their order, an entity named by the place of its first card.

    A card joins the entity that has its INN; else the entity that was last opened under its name, if that one's INN or
    its own is blank; else it opens one. What an entity is depends on the order, but only through a few cards of each
    name, which aggregates find: an INN's first card opens an entity, or takes over the name's first card without an
    INN, if that came before any entity of the name and no other INN has taken it; cards without an INN join the entity
    opened last before them. The last is a running value, by a prefix scan: a name may have half of all cards.

    A null name is none: without an INN such a card stays alone. Places are unique.
    """
    cards = companies.select(F.col(order).alias("at"), F.col(name_key).alias("name"), F.coalesce(F.col(inn), F.lit("")).alias("inn"))
    first = cards.where("inn <> ''").groupBy("inn").agg(F.min(F.struct("at", "name")).alias("f")).select("inn", "f.at", "f.name")
    taker = first.where("name IS NOT NULL").groupBy("name").agg(F.min("at").alias("taken_at"))
    blank = cards.where("inn = '' AND name IS NOT NULL")
    opened = blank.groupBy("name").agg(F.min("at").alias("opened_at")).join(taker, "name", "left").where("taken_at IS NULL OR opened_at < taken_at")
    opened = saved(opened, "entities-opened")
    by_inn = first.join(opened, "name", "left").select("inn", "name", "at", F.when(F.col("at") == F.col("taken_at"), F.col("opened_at")).otherwise(F.col("at")).alias("entity"))
    by_inn = saved(by_inn, "entities-inn")

    # at one place an opening comes before the card
    events = [
        opened.select("name", F.col("opened_at").alias("at"), F.lit(0).alias("card"), F.col("opened_at").alias("entity")),
        by_inn.where("name IS NOT NULL").select("name", "at", F.lit(0).alias("card"), "entity"),
        blank.select("name", "at", F.lit(1).alias("card"), F.lit(None).cast(cards.schema["at"].dataType).alias("entity")),
    ]
    followed = running(events[0].unionByName(events[1]).unionByName(events[2]), ["name"], ["at", "card"], lasts={"into": F.col("entity")})
    return (
        cards.where("inn <> ''").join(by_inn.select("inn", "entity"), "inn").select("at", "entity")
        .unionByName(followed.where("card = 1").select("at", F.col("into").alias("entity")))
        .unionByName(cards.where("inn = '' AND name IS NULL").select("at", F.col("at").alias("entity")))
    )


def merged_cards(companies: DataFrame, entities: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """One card for each entity (see merge_entities): of each field the first value that isn't blank; internal and manual
    if any card is (scope, source), archived if all are."""
    each = companies.join(entities.select(F.col("at").alias(order), "entity"), order)
    firsts = [F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col(order))), F.lit("")).alias(c) for c in fields]
    flags = [F.when(F.count_if(F.col(c) == v) > 0, v).otherwise(F.min_by(c, order)).alias(c) for c, v in (("scope", "internal"), ("source", "manual"))]
    return each.groupBy("entity").agg(F.min_by("name", order).alias("name"), *firsts, *flags, F.min("archived").alias("archived"))


def merged_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (source, target, type, note) between entities, repeated ones once; a target that is no card stays."""
    ends = entities.where("at <> entity")
    for end in ("source", "target"):
        relations = relations.join(ends.select(F.col("at").alias(end), F.col("entity").alias("_entity")), end, "left").withColumn(end, F.coalesce("_entity", end)).drop("_entity")
    return relations.select("source", "target", "type", "note").distinct()
