"""From the cells of an imported sheet to records: mapping, defaults, checks, corrections and merges.

Sheets are frames (row_idx, cells) as sources.tables gives them; a mapping names the cell of each field, fields
that the sheet doesn't have are left out of it or have -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from millrace.functions.text import text


def cell(mapping: dict[str, int], field: str, cells: str = "cells") -> Column:
    """The trimmed cell of a field; blank where the field or the cell is missing."""
    at = mapping.get(field, -1)
    return F.trim(text(F.get(F.col(cells), F.lit(at)))) if at >= 0 else F.lit("")


def mapped_rows(sheet: DataFrame, mapping: dict[str, int], fields: list[str], defaults: dict[str, str] | None = None, allowed: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """(row, fields..., issues): one row for each row of the sheet below its header that isn't blank. A blank field takes
    its default; a value that isn't among the `allowed` of its field is an issue and becomes the fallback. `row` is
    the row's number as the sheet shows it (the first below the header is 2)."""
    defaults, allowed = defaults or {}, allowed or {}
    rows = sheet.where(F.exists("cells", lambda c: F.trim(text(c)) != ""))
    raw = {f: F.coalesce(F.nullif(cell(mapping, f), F.lit("")), F.lit(defaults.get(f, ""))) for f in fields}
    row = F.col("row_idx") + 2
    unknown = lambda f: (raw[f] != "") & ~raw[f].isin(allowed[f][0])
    issues = F.array_compact(F.array(*[F.when(unknown(f), F.struct(row.alias("row"), F.lit(f).alias("field"), raw[f].alias("value"))) for f in allowed])) if allowed else F.array().cast("array<struct<row:int,field:string,value:string>>")
    final = {f: F.when(raw[f].isin(allowed[f][0]), raw[f]).otherwise(F.lit(allowed[f][1])) if f in allowed else raw[f] for f in fields}
    return rows.select(row.alias("row"), *[c.alias(f) for f, c in final.items()], issues.alias("issues"))


def _json(value: Column) -> Column:
    """The JSON text of a value of any type."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, 6, F.length(wrapped) - 6)


def _value(json: Column, kind: DataType) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), StructType([StructField("v", kind)]))["v"]


def patches(baseline: DataFrame, edited: DataFrame, key: str = "row") -> DataFrame:
    """(key, field, value): what an edit has changed, a row for each field whose JSON differs; the value is JSON, so that
    lists and null come back as they are."""
    fields = [c for c in edited.columns if c != key]
    sides = [df.select(key, *[_json(F.col(c)).alias(f"{side}_{c}") for c in fields]) for side, df in (("old", baseline), ("new", edited))]
    both = sides[0].join(sides[1], key)
    changes = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"new_{c}").alias("value"))) for c in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*changes))).alias("c")).select(key, "c.field", "c.value")


def patched(rows: DataFrame, overrides: DataFrame, key: str = "row", order: str | None = None) -> DataFrame:
    """rows with the fields that `overrides` (key, field, value as JSON) sets. Of a field that is set more than once the
    last value counts, by the column `order` (without one the greatest JSON text)."""
    fields = [c for c in rows.columns if c != key]
    each = overrides.groupBy(key, "field").agg((F.max_by("value", order) if order else F.max("value")).alias("value"))
    wide = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_set"))
    value = lambda c: F.when(F.map_contains_key("_set", F.lit(c)), _value(F.col("_set")[c], rows.schema[c].dataType)).otherwise(F.col(c))
    return rows.join(wide, key, "left").select(key, *[value(c).alias(c) for c in fields])


def assignment_patches(before: Column, after: Column, fields: list[str]) -> Column:
    """What an edit has changed in a list of structs, (replacement, patches): entry by entry the JSON of the fields that
    differ, or, if the lists differ in length, the whole list."""
    changed = lambda b, a: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.when(~_json(b[f]).eqNullSafe(_json(a[f])), _json(a[f])) for f in fields])), lambda _, v: v.isNotNull())
    same = F.size(before) == F.size(after)
    return F.struct(F.when(~same, after).alias("replacement"), F.when(same, F.zip_with(before, after, changed)).alias("patches"))


def with_assignments(current: Column, override: Column, schema: StructType) -> Column:
    """A list of structs after assignment_patches; schema is that of its entries."""
    entry = lambda x, i: F.struct(*[F.coalesce(_value(F.get(override["patches"], i)[f.name], f.dataType), F.when(F.get(override["patches"], i)[f.name].isNull(), x[f.name])).alias(f.name) for f in schema.fields])
    return F.when(override.isNull(), current).otherwise(F.coalesce(override["replacement"], F.transform(current, entry)))


def missing_fields(required: dict[str, Column]) -> Column:
    """The names of the required fields whose condition (of being missing) holds, in their order."""
    return F.array_compact(F.array(*[F.when(missing, F.lit(name)) for name, missing in required.items()]))


def merged_update(previous: DataFrame, imported: DataFrame, key: str, mapping: dict[str, int], copies: dict[str, list[str]]) -> DataFrame:
    """previous with the fields that an import has: copies names the columns that each mapped field overwrites. Rows
    that the import doesn't have stay as they are."""
    taken = {c for f, columns in copies.items() if mapping.get(f, -1) >= 0 for c in columns}
    new = imported.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in taken])
    joined = previous.join(new, key, "left")
    return joined.select(*[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in previous.columns])


def merged_documents(previous: Column, imported: Column, mapping: dict[str, int]) -> Column:
    """Documents (category, ...) of which the categories that the import has are replaced as groups."""
    has = lambda *fields: any(mapping.get(f, -1) >= 0 for f in fields)
    replaced = ["certificate"] * has("certificates", "certificateStatuses") + ["education"] * has("education")
    if not replaced:
        return previous
    return F.concat(F.filter(previous, lambda d: ~text(d["category"]).isin(replaced)), F.filter(imported, lambda d: text(d["category"]).isin(replaced)))
