"""Filter interaction audit: what every filter removes at every step of every order of the filters.

The orders of n filters are the paths of a lattice: its nodes are the subsets already applied, an edge (subset, next
filter) is a step, and n * 2**(n-1) edges serve all n! orders (80 edges for the 120 orders of five). What a step does
to a document depends on its edge and on the set of filters that the document fails. So documents are counted by that
set first, each count goes to all edges, the edges are summed by part, and the aggregated edges are joined to the
n! * n steps. A filter's Shapley value times n! is the sum of what it removes over all orders: edges weighted by the
number of orders that pass through them.

A repeat fails for a text that a smaller id has anywhere in the table. Texts are known by SHA-256 and are never
gathered: rows are pre-aggregated by (digest, part, failures, labels), so thousands of copies are a few rows before
the least id of a digest is looked up.

Defined results: a null text is empty, and so a copy of any empty text; a null part is the empty string. A null id is
smaller and larger than none: such a row fails no repeat and makes none fail. Rows that repeat an id have the same
id, so they are no repeats of each other, and all of them count. Of labels that repeat an id, any 1 counts; a label
of a null id belongs to nobody. An empty table has no parts and gives no rows; no labels give zeros. Columns besides
the id, text, part and labels are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_checks(few_words: int = 100, distinct_pct: int = 80, capitals_pct: int = 10) -> dict[str, Column]:
    """Failures A to D of a `text` that has its `words`."""
    size = lambda x: F.size(x).cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    return {
        "A": size(F.col("words")) < few_words,
        "B": 100 * size(F.array_distinct("words")) < distinct_pct * size(F.col("words")),
        "C": 100 * capitals > capitals_pct * F.length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def edges_of(n: int) -> list[tuple[int, int, int]]:
    """(subset, filter, number of orders that pass) of every edge; filters are bits."""
    return [(s, 1 << f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def steps_of(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, subset, filter) of every step of every order."""
    found = []
    for order in permutations(range(len(letters))):
        name, subset = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            found.append((name, step, subset, 1 << f))
            subset |= 1 << f
    return found


def failures(docs: DataFrame, labels: DataFrame, checks: dict[str, Column], part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail; the last bit is the repeat."""
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", "[ \\t-\\r]+", -1), lambda w: w != "")
    masked = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())]
    slim = texts.withColumn("words", words).select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), sum(masked[1:], masked[0]).alias("mask"))
    slim = slim.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]).where("good = 1 OR toxic = 1")
    known = slim.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]).withColumn("nameless", F.col("doc_id").isNull())

    group = ["digest", "part", "mask", "good", "toxic", "nameless"]
    copies = known.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passes = F.when(F.col("nameless"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    copies = copies.withColumn("passes", passes)
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + (1 << len(checks))).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    each = copies.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    marked = [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")]
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *marked)


def audit(docs: DataFrame, labels: DataFrame, checks: dict[str, Column] | None = None, repeat: str = "E", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for
    every part, order and step. checks are failures by letter, over `text` and `words`; `repeat` names the repeat."""
    checks = checks or text_checks()
    letters = "".join(checks) + repeat
    if len(letters) != len({*letters}) or len(letters) != len(checks) + 1 or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters are at most {MOST_FILTERS}, with a letter of their own each")
    classes = failures(docs, labels, checks, part)

    lattice = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter"), F.lit(w).alias("orders")) for s, f, w in edges_of(len(letters))])
    met = classes.select("*", F.inline(lattice))
    reached = F.col("mask").bitwiseAND(F.col("subset")) == 0
    fails = F.col("mask").bitwiseAND(F.col("filter")) != 0
    of = {"kept": (reached & ~fails, "n"), "removed": (reached & fails, "n"), "redundant": (~reached & fails, "n"), "unique_fails": (F.col("mask") == F.col("filter"), "n"), "good_lost": (reached & fails, "good"), "toxic_lost": (reached & fails, "toxic")}
    edges = met.groupBy("part", "subset", "filter", "orders").agg(*[F.sum(F.when(of[c][0], F.col(of[c][1])).otherwise(0)).alias(c) for c in COUNTS])
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))

    values = ", ".join(map(str, steps_of(letters)))
    # n! * n rows, at most 4,320
    steps = F.broadcast(docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS steps(filter_order, step, subset, filter)"))
    return edges.join(steps, ["subset", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
