"""Page ranges such as "1-3, 5" as arrays of places from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_ranges(spec: Column, count: Column, distinct: bool = False) -> Column:
    """(pages, error): places in the order given, or sorted without repeats. Reversed, unreadable or missing
    pages are errors, and so are repeated ones unless `distinct`."""
    parts = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.trim(p))
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    bounds = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int").alias("b")))
    out = F.exists(bounds, lambda x: (x["a"] < 1) | (x["b"] > count) | (x["a"] > x["b"]))
    pages = F.flatten(F.transform(bounds, lambda x: F.sequence(x["a"] - 1, x["b"] - 1)))
    error = F.when(bad, "unreadable").when(out, "out-of-range")
    if distinct:
        pages = F.array_sort(F.array_distinct(F.when(error.isNull(), pages)))
    else:
        pages = F.when(error.isNull(), pages)
        error = F.coalesce(error, F.when(F.size(F.array_distinct(pages)) < F.size(pages), "repeated"))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def reorder(order: Column, selected: Column) -> Column:
    """The pages of `order` at the selected places."""
    return F.transform(selected, lambda i: F.get(order, i))


def block_errors(blocks: Column) -> Column:
    """For named blocks (name, file_name, pages), what is wrong: `no-blocks`, else of each block in their order `no-name`,
    `unusable-name` or, for a file name that an earlier block has, `repeated-name`."""

    def wrong(b: Column, i: Column) -> Column:
        earlier = F.exists(F.slice(blocks, 1, i), lambda e: F.lower(e["file_name"]) == F.lower(b["file_name"]))
        return F.when(F.trim(b["name"]) == "", "no-name").when(b["file_name"] == "", "unusable-name").when(earlier, "repeated-name")

    return F.when(F.size(blocks) == 0, F.array(F.lit("no-blocks"))).otherwise(F.array_compact(F.transform(blocks, wrong)))


def page_jitter(seed: Column, page: Column, salt: int = 0) -> Column:
    """A number from 0 to 1 for a page (from 0), the same for the same seed, page and salt: 32-bit arithmetic."""
    mask = F.lit(0xFFFFFFFF)
    mixed = (seed.cast("long") * 1_664_525 + (page.cast("long") + 1) * 1_013_904_223 + F.lit(salt)).bitwiseAND(mask)
    return mixed.bitwiseXOR(F.shiftright(mixed, 16)) / F.lit(float(0xFFFFFFFF))


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    """The value, 0 if it isn't finite, between two bounds; the upper one wins if they are reversed."""
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.least(lit(high), F.greatest(lit(low), finite))


def placed_rect(rect: Column, least: float = 0.01) -> Column:
    """A rectangle (x, y, width, height) inside the unit square, at least `least` wide and high."""
    x, y = (clamped(rect[c], 0, 1 - least) for c in ("x", "y"))
    size = lambda c, at: clamped(rect[c], least, 1 - at)
    return F.struct(x.alias("x"), y.alias("y"), size("width", x).alias("width"), size("height", y).alias("height"))


def moved_rect(rect: Column, dx: Column, dy: Column) -> Column:
    """A placed rectangle, moved as far as the unit square allows."""
    own = placed_rect(rect)
    return F.struct(clamped(own["x"] + dx, 0, 1 - own["width"]).alias("x"), clamped(own["y"] + dy, 0, 1 - own["height"]).alias("y"), own["width"].alias("width"), own["height"].alias("height"))


def rotated_size(width: Column, height: Column, degrees: Column) -> Column:
    """(width, height) of the upright box around a rotated one."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.struct((width * c + height * s).alias("width"), (width * s + height * c).alias("height"))
