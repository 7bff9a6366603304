"""CSV in the spreadsheet dialect, read in splits: a quoted cell may hold line feeds and lie over any number of splits.

A cell is quoted after an odd number of quotes, so what a split needs to know of all before it is one bit. Spark's text
source cuts files into splits at line feeds. A first pass counts the quotes of every split, a prefix sum over the
splits of a file gives the bit at which each begins, and a second pass parses every split on its own. Records that lie
over cuts come out as fragments, which are put together by their first split. Row numbers are counts in two levels:
rows of a split, and of the splits before it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.shared import saved

#: Splits whose bits are broadcast (beyond, lines are joined by a shuffle), and characters that a record may have.
MOST_BROADCAST, MOST_RECORD = 500_000, 256 << 20
BOM = "﻿"
#: What is trimmed from cells.
BLANKS = "\t\n\x0b\x0c\r \xa0                　" + BOM
PARSED = "file string, start long, n int, cells array<string>, kind string, fragment string"


def sniff_delimiter(first_line: str) -> str:
    return ";" if first_line.count(";") >= first_line.count(",") else ","


def parse(text: str, delimiter: str) -> list[list[str]]:
    """Rows of a text that begins outside of quotes, empty ones left out. A quote opens or closes anywhere in a cell;
    a doubled one inside of quotes is a quote."""
    rows, row, cell = [], [], ""
    pieces = text.split('"')
    for i, piece in enumerate(pieces):
        if i % 2:
            cell += piece
        elif not piece and 0 < i < len(pieces) - 1:
            cell += '"'
        else:
            for j, line in enumerate(re.split("\r\n|\r|\n", piece)):
                if j:
                    rows.append([*row, cell])
                    row, cell = [], ""
                first, *others = line.split(delimiter)
                cell += first
                for other in others:
                    row.append(cell)
                    cell = other
    rows.append([*row, cell])
    rows = [[c.strip(BLANKS) for c in r] for r in rows]
    return [r for r in rows if any(r)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, delimiter) of every split: whether it begins inside of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"), F.min_by("value", "at").alias("first"))
    of_file = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    commas, semicolons = (F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit(""))) for c in ",;")
    found = splits.select("file", "start", (before % 2 == 1).alias("inside"), F.first("first").over(of_file).alias("line"))
    return found.select("file", "start", "inside", F.when(semicolons >= commas, ";").otherwise(",").alias("delimiter"))


def _parsed(frames):
    """Rows of each split with their numbers in it, and the fragments at its ends: `head` up to where the record that it
    begins in is over, `tail` from where its last record begins, `whole` if it is all inside of one."""
    now, state, n, text, inside, kind = None, None, 0, [], False, None
    out: list[tuple] = []

    def fragment(as_kind: str):
        out.append((*now, None, None, as_kind, "\n".join(text) + "\n"))

    def closed():
        if now is not None and text:
            fragment("whole" if kind == "head" else "tail")

    for frame in frames:
        for file, start, value, begins_inside, delimiter in frame[["file", "start", "value", "inside", "delimiter"]].itertuples(index=False):
            if (file, start) != now:
                closed()
                now, n, text, inside, state = (file, start), 0, [], begins_inside, delimiter
                kind = "head" if inside else None
                if start == 0:
                    value = value.removeprefix(BOM)
            if value.count('"') % 2:
                inside = not inside
            elif not text and not inside and '"' not in value and "\r" not in value[:-1]:
                row = [c.strip(BLANKS) for c in value.split(state)]
                if any(row):
                    out.append((*now, n, row, None, None))
                    n += 1
                continue
            text.append(value)
            if not inside:
                if kind == "head":
                    fragment("head")
                else:
                    for row in parse("\n".join(text), state):
                        out.append((*now, n, row, None, None))
                        n += 1
                text, kind = [], None
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["file", "start", "n", "cells", "kind", "fragment"]).astype({"n": "Int32"})
                out = []
    closed()
    if out:
        yield pd.DataFrame(out, columns=["file", "start", "n", "cells", "kind", "fragment"]).astype({"n": "Int32"})


def _joined(fragments: DataFrame, states: DataFrame) -> DataFrame:
    """(file, start, j, cells) of the records that lie over cuts, under the split where they begin. A file that ends
    inside of quotes ends its last record, too."""
    by_file = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == "tail", F.col("start")), ignorenulls=True).over(by_file)
    named = fragments.withColumn("begun", begun).join(states.select("file", "start", "delimiter"), ["file", "start"])
    size = F.sum(F.length("fragment"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "fragment"))), lambda x: x["fragment"]), "")
    texts = named.groupBy("file", F.col("begun").alias("start"), "delimiter").agg(F.when(size <= MOST_RECORD, parts).otherwise(F.raise_error(F.lit("a record of more characters than one may have"))).alias("text"))

    def run(frames):
        for frame in frames:
            rows = [(f, s, j, cells) for f, s, d, t in frame.itertuples(index=False) for j, cells in enumerate(parse(t, d))]
            yield pd.DataFrame(rows, columns=["file", "start", "j", "cells"])

    return texts.select("file", "start", "delimiter", "text").mapInPandas(run, "file string, start long, j int, cells array<string>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, cells) of CSV files: the delimiter by each file's first line, cells trimmed, empty rows dropped,
    rows numbered from 0 in each file."""
    lines = _lines(spark, path)
    states = saved(_states(lines), "csv-states")
    if states.count() <= MOST_BROADCAST:
        # one row a split, and no more than the bound
        ready = lines.join(F.broadcast(states), ["file", "start"])
    else:
        ready = lines.join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "at")
    parsed = saved(ready.select("file", "start", "value", "inside", "delimiter").mapInPandas(_parsed, PARSED), "csv")
    own = parsed.where("kind IS NULL").select("file", "start", F.lit(0).alias("later"), F.col("n").alias("j"), "cells")
    over = _joined(parsed.where("kind IS NOT NULL").select("file", "start", "kind", "fragment"), states)
    # a record that goes beyond its split is the last that begins there
    rows = own.unionByName(over.select("file", "start", F.lit(1).alias("later"), "j", "cells"))
    counts = rows.groupBy("file", "start", "later").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("file").orderBy("start", "later").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("file", "start", "later", before.alias("first"))
    return rows.join(firsts, ["file", "start", "later"]).select("file", (F.col("first") + F.col("j")).alias("row_idx"), "cells")
