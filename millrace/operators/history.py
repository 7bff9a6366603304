"""History operators: flattened JSON, differences between snapshots, paths inside records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = ("id", "createdAt", "updatedAt", "schemaVersion")


def json_depth(payload: Column) -> Column:
    """How deep arrays and objects of a JSON text nest, from its brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(payload, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]+", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))
    steps = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.coalesce(F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]), F.lit(0))


def flatten_json(df: DataFrame, id_col: str, json_col: str, most_depth: int = 64) -> DataFrame:
    """(id, path, value) of every leaf of a JSON text; array entries are numbered from 1, what is empty is a leaf. Unreadable
    text has none.

    Texts are parsed into variants, which are exploded a level at a time, as many times as the deepest one needs; a leaf
    stays what it is. Deeper texts than most_depth are an error.
    """
    spark = df.sparkSession
    slim = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("payload")).where(F.col("payload") != "")
    deepest = slim.agg(F.max(F.when(F.try_parse_json("payload").isNotNull(), json_depth(F.col("payload"))))).first()[0] or 0
    if deepest > most_depth:
        raise ValueError(f"a JSON text nests {deepest} deep, and {most_depth} is the bound")
    level = slim.select("id", F.lit("").alias("path"), F.try_parse_json("payload").alias("v")).where("v IS NOT NULL")
    for _ in range(deepest):
        level = spark.sql(
            """SELECT t.id, IF(x.pos IS NULL, t.path, concat(t.path, IF(t.path = '', '', '.'), coalesce(x.key, concat('№ ', x.pos + 1)))) AS path, IF(x.pos IS NULL, t.v, x.value) AS v
            FROM {t} t, LATERAL variant_explode_outer(t.v) AS x""",
            t=level,
        )
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
    return level.where("path <> ''").select("id", "path", text.alias("value"))


def diff(old: DataFrame, new: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(id, path, old, new) of the leaves (id, path, value) that differ; a missing one is a dash."""
    keep = ~F.split("path", r"\.")[0].isin(*ignored)
    a, b = old.where(keep).withColumnRenamed("value", "old"), new.where(keep).withColumnRenamed("value", "new")
    both = a.join(b, ["id", "path"], "full_outer")
    return both.select("id", "path", F.coalesce("old", F.lit("—")).alias("old"), F.coalesce("new", F.lit("—")).alias("new")).where("old <> new")


def paths_in(leaves: DataFrame, key: str = "relativePath", prefix: str = "attachments/") -> DataFrame:
    """Distinct values of a key anywhere in flattened records, under a prefix."""
    return leaves.where((F.element_at(F.split("path", r"\."), -1) == key) & F.col("value").startswith(prefix)).select(F.col("value").alias("path")).distinct()


def labelled(leaves: DataFrame, labels: dict[str, str], ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(id, field, value) as a reader sees them: names of the path by their labels and joined by slashes, what is empty as
    a dash, truth values as words; leaves under ignored names, at any depth, are left out."""
    names = F.split("path", r"\.")
    shown = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.lit(None).cast("map<string,string>")
    field = F.array_join(F.transform(names, lambda n: F.coalesce(F.element_at(shown, n), n)), " / ")
    value = F.when(F.col("value").isin("", "null", "{}", "[]"), "—").when(F.col("value") == "true", "Да").when(F.col("value") == "false", "Нет").otherwise(F.col("value"))
    return leaves.where(~F.exists(names, lambda n: n.isin(*ignored))).select("id", field.alias("field"), value.alias("value"))
