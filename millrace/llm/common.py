"""Shared folder handling and connected components for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Only a local master, whose tasks see the
    driver's disk, may go without: it gets a temporary folder, and the session stays as it is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most: documents are long, and Spark's 10,000 would hold tens of MB at
    once in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder to cut lineage, so a lost executor costs a re-read, not a re-run.

    The folder of one call stays while its result may still be read; `drop` removes a table that no later
    step needs. Tables are plain Parquet and compress, unlike RDD checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{label}")
        return self.read(label, df)

    def read(self, label: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{label}")

    def drop(self, *labels: str) -> None:
        for label in labels:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Components of an undirected graph given as edges (a, b): rows (node, component), component the least node.

    The graph is contracted in rounds. Nodes are ordered by a hash of their names, each node moves into the least
    of itself and its neighbours, and the edges are carried over to where their ends have moved; loops and repeats
    go. The node that is last in that order always moves, so rounds end; of a path about half of the nodes move in
    a round, however its names lie along it, and a star is gone after two, so rounds grow with the logarithm of the
    graph. The order is another one every few rounds. The least neighbour is a pre-aggregated minimum, so a hub is
    no hot group. Names are traced through the rounds at the end, from the last and smallest one back.

    Self-loops and repeated edges are allowed, nulls are ignored, no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live, moves = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges-0"), []
    while not live.isEmpty():
        i = len(moves)
        placed = lambda c, i=i: F.struct(F.xxhash64(c, F.lit(i // 4)).alias("place"), F.col(c).alias("into"))
        ends = live.select(F.col("a").alias("node"), placed("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), placed("a").alias("to")))
        move = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", placed("node"))["into"].alias("into"))
        moves.append(scratch.save(move, f"{label}-moves-{i}"))
        ends = [moves[-1].select(F.col("node").alias(c), F.col("into").alias(f"{c}2")) for c in "ab"]
        moved = live.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        live = scratch.save(moved.distinct(), f"{label}-edges-{i + 1}")
        scratch.drop(f"{label}-edges-{i}")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = moves[-1]
    for i, move in reversed(list(enumerate(moves[:-1]))):
        later = whole.select(F.col("node").alias("into"), F.col("into").alias("last"))
        whole = move.join(later, "into", "left").select("node", F.coalesce("last", "into").alias("into"))
        if i % 4 == 0:
            whole = scratch.save(whole, f"{label}-names-{i}")
    least = whole.groupBy("into").agg(F.min("node").alias("component"))
    found = scratch.save(whole.join(least, "into").select("node", "component"), f"{label}-components")
    scratch.drop(*(f"{label}-{kind}-{i}" for i in range(len(moves)) for kind in ("moves", "names")), f"{label}-edges-{len(moves)}")
    return found


def renamed(df: DataFrame, merged: DataFrame) -> DataFrame:
    """df with components replaced by those that they have merged into."""
    names = merged.select(F.col("node").alias("component"), F.col("component").alias("_into"))
    return df.join(names, "component", "left").withColumn("component", F.coalesce("_into", "component")).select(*df.columns)


def unsettled(live: DataFrame) -> DataFrame:
    """The groups (sig, component, ...) whose members are in several components."""
    split = live.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return live.join(split, "sig", "left_semi")
