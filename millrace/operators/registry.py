"""Registry operators: search, lookups, integrity, duplicates, facets, archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, fields: list[Column], needle: str, equal: dict[str, str] | None = None, trim: bool = False) -> DataFrame:
    """Rows whose joined fields contain the needle in any case; a blank needle or filter lets all pass."""
    needle = (needle.strip() if trim else needle).lower()
    out = df.where(F.lower(F.concat_ws(" ", *fields)).contains(needle)) if needle else df
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] else d, (equal or {}).items(), out)


def any_of(df: DataFrame, array: str, equal: dict[str, str]) -> DataFrame:
    """Rows where each condition holds for some entry of the array, not necessarily the same one."""
    return reduce(lambda d, kv: d.where(F.exists(array, lambda x: x[kv[0]] == kv[1])) if kv[1] else d, equal.items(), df)


def one_of(df: DataFrame, array: str, equal: dict[str, str]) -> DataFrame:
    """Rows where all conditions hold for one entry of the array."""
    known = {k: v for k, v in equal.items() if v}
    return df.where(F.exists(array, lambda x: reduce(lambda a, kv: a & (x[kv[0]] == kv[1]), known.items(), F.lit(True)))) if known else df


def lookup(df: DataFrame, other: DataFrame, by_id: tuple[str, str], by_name: tuple[Column, str], columns: list[str]) -> DataFrame:
    """Columns of the row with the id, else of the row with the name; `other` has each at most once."""
    first = other.select(F.col(by_id[1]).alias("_id"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    second = other.select(F.col(by_name[1]).alias("_name"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    out = df.join(first, df[by_id[0]] == F.col("_id"), "left").join(second, by_name[0] == F.col("_name"), "left")
    # a row found by its id keeps that row's nulls
    return out.select(*[df[c] for c in df.columns], *[F.when(F.col("_id").isNotNull(), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in columns])


def used_by_either(df: DataFrame, others: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows that any (frame, its key, own key) refers to: an OR of keys as a union of hash semi-joins."""
    hits = [df.join(o.select(F.col(k).alias("_k")).distinct(), df[own] == F.col("_k"), "left_semi") for o, k, own in others]
    return reduce(DataFrame.unionByName, hits).distinct()


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is set but has no row in the target."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def orphans(stored: DataFrame, key: str, size: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """(orphan_count, orphan_size) of the stored rows that nothing refers to."""
    used = reduce(DataFrame.unionByName, [r.select(F.col(k).alias("_k")) for r, k in references])
    return stored.join(used, stored[key] == F.col("_k"), "left_anti").agg(F.count("*").alias("orphan_count"), F.coalesce(F.sum(size), F.lit(0)).alias("orphan_size"))


def repeats(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """All rows of a key but the first. Keys of one row need no sort: groups are counted first."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    first = named.groupBy(*names).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = reduce(lambda a, b: a & b, [named[n].eqNullSafe(first[n]) for n in names])
    return named.join(first, same).where(F.struct(*order) != F.col("_first")).select(*[named[c] for c in df.columns])


def upsert_match(incoming: DataFrame, existing: DataFrame, id_col: str, key: str, optional: list[str]) -> DataFrame:
    """The row of `existing` that each incoming row updates, or the number of candidates if that isn't one.

    Candidates share the key; each optional column narrows them while more than one is left, if it is given.
    """
    # candidates are counted by key and each choice of optional columns, so that no pairs are made
    given = [f"_given_{c}" for c in optional]
    pool = existing.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), F.expr(f"array({', '.join(f'CAST(`{c}` AS STRING)' for c in optional)})").alias("_all"))
    every = F.array(*[F.array(*[F.col("_all")[i] if mask >> i & 1 else F.lit(None).cast("string") for i in range(len(optional))]) for mask in range(1 << len(optional))])
    by = pool.select("_key", "_id", F.posexplode(every).alias("_mask", "_by")).groupBy("_key", "_mask", "_by").agg(F.count("*").cast("int").alias("_n"), F.min("_id").alias("_least"))

    def counted(rows):
        values = F.array(*[F.when(F.col("_used").bitwiseAND(1 << i) != 0, F.col(g)) for i, g in enumerate(given)])
        rows = rows.drop("_n", "_least").withColumn("_want", values)
        met = rows.join(by, (rows[key] == by["_key"]) & (rows["_used"] == by["_mask"]) & (rows["_want"] == by["_by"]), "left")
        return met.select("row", key, *given, "_used", F.coalesce("_n", F.lit(0)).alias("_n"), "_least")

    found = counted(incoming.select("row", key, *[F.col(c).cast("string").alias(g) for c, g in zip(optional, given, strict=True)], F.lit(0).alias("_used")))
    for i, g in enumerate(given):
        narrows = (F.col("_n") > 1) & (F.coalesce(F.col(g), F.lit("")) != "")
        found = counted(found.withColumn("_used", F.when(narrows, F.col("_used").bitwiseOR(1 << i)).otherwise(F.col("_used"))))
    return found.select("row", F.col("_n").alias("candidates"), F.when(F.col("_n") == 1, F.col("_least")).alias("matched"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): distinct values that aren't blank, counted in one pass over all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).where("trim(coalesce(p.value, '')) <> ''").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def tagged_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of all modules with the module's name."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("module"), *df.columns) for name, df in frames.items()])


def failed_checks(df: DataFrame, checks: list[tuple[str, str, Column]]) -> Column:
    """Array of (code, severity) of the checks that fail, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in checks]))
