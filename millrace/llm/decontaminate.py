"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, the units after them and names (capitalised inside a sentence)
become typed placeholders whose values are kept aside. Windows of WIDTH canonical words are hashed on both sides
and joined, so a question with other numbers and names still meets its template. Every text has two views, with
and without names as placeholders, as texts in capitals have no names to see.

A run of names is one placeholder. A joined window puts words of an item on words of a document. All matches of an
item within SPAN times its words of the document (up to twice as many, as such spans overlap by half) belong
together, so asides and longer names may come between. Of them, an ascending chain counts, in which no word of
the item or the document comes twice, and slots must be consistent: an item's value stands for one value of the
document, and slots that say otherwise don't count. A document is contaminated where at least `share` of an
item's words are covered.

Documents hash their windows where they lie and only windows that the benchmark has leave the task: the
benchmark's distinct hashes are sent to tasks in parts of at most HASHES, each with a pass of its own. The join
and all that follows sees only those matches.

Defined results: a text with fewer than WIDTH words is one window, so such an item matches only documents that
are no more than it. Windows with fewer than two words outside placeholders (one, in shorter texts) are not
templates and are not joined. A null or empty text or item matches nothing. Rows with a null id are judged as
others are; repeated rows get the same decision. Documents without words are clean. Ties go to the least item.
Columns besides those named are carried or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, small_batches
from millrace.llm.textops import hash_strings, shingles, slices, split_words

WIDTH, DRIFT, SPAN, HASHES = 5, 4, 3, 4_000_000
#: Words that are units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v volt volts a amp amps j kj kcal cal n pa kpa bar k c f degree degrees percent cent cents dollar dollars euro euros usd eur kb mb gb tb mph kmh"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))
HITS = "doc long, text_hash long, at int, hash long, slots array<long>, places array<int>"


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plain, named, values, offsets): hashes of canonical words without and with names as placeholders, the
    hash of each word's own value, and the offsets of each text."""
    words, offsets = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    own, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    core = pc.replace_substring_regex(own, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    low = pc.utf8_lower(core)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)[codes] if len(own) else np.zeros(0, bool)
    full = flag(pc.not_equal(low, ""))
    number = flag(pc.match_substring_regex(low, r"^\p{N}+([.,:/]\p{N}+)*$"))
    unit = flag(pc.is_in(low, pa.array(UNITS, low.type)))
    capital = flag(pc.match_substring_regex(core, r"^\p{Lu}"))
    ends = flag(pc.match_substring_regex(own, r"[.!?…:;][^\p{L}\p{N}]*$"))
    values = hash_strings(low)[codes] if len(own) else np.zeros(0, np.uint64)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][offsets[:-1] < len(codes)]] = True
    opens = first.copy()
    opens[1:] |= ends[:-1]
    kept = np.concatenate([[0], np.cumsum(full)])
    opens, number, unit, capital, values, offsets = opens[full], number[full], unit[full], capital[full], values[full], kept[offsets]
    measured = np.zeros(len(number), bool)
    measured[1:] = unit[1:] & number[:-1]
    plain = np.where(number, NUMBER, np.where(measured, UNIT, values))
    named = np.where(capital & ~opens & ~number & ~measured, NAME, plain)
    return plain, named, values, offsets.astype(np.int64)


def windows(texts: pa.Array, width: int = WIDTH):
    """Windows that are templates, of both views: (text, place of the first word, hash, start, end, slot values by
    token, 0 outside placeholders; place and number of words by token). A run of names is one token."""
    plain, named, values, offsets = canonical(texts)
    places = (np.arange(len(plain)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.int32)
    found = []
    for view in (plain, named):
        name = view == NAME
        first = np.ones(len(view), bool)
        first[1:] = ~(name[1:] & name[:-1]) | (places[1:] == 0)
        at = np.flatnonzero(first)
        kept = np.concatenate([[0], np.cumsum(first)])[offsets]
        own, lens, place = view[at], np.diff(np.append(at, len(view))).astype(np.int32), places[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        value = sums[at + lens] - sums[at]
        hashes, ends = shingles(own, kept, width)
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        start = kept[text] + np.arange(len(hashes)) - ends[text]
        end = np.minimum(start + width, kept[text + 1])
        slot = (own == NUMBER) | (own == UNIT) | (own == NAME)
        literal = np.concatenate([[0], np.cumsum(~slot)])
        good = literal[end] - literal[start] >= np.where(end - start < width, 1, 2)
        if view is named:  # others are windows of the first view
            names = np.concatenate([[0], np.cumsum(own == NAME)])
            good &= names[end] > names[start]
        found.append((text[good], place[start[good]], hashes[good], start[good], end[good], np.where(slot, value | np.uint64(1), np.uint64(0)), place, lens))
    return found


def _rows(text, place, hashes, start, end, slots, places, lens, keep: np.ndarray):
    text, place, hashes, start, end = (x[keep] for x in (text, place, hashes, start, end))
    lists = [[x[a:b] for a, b in zip(start, end, strict=True)] for x in (slots.view(np.int64), places, lens)]
    return text, place.astype(np.int32), hashes.view(np.int64), *(pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int32(), pa.int32()), strict=True))


def _chain(cells: list[tuple], n_words: int) -> list[tuple]:
    """The heaviest of the chains of cells (doc place, item place, words, value, meant) that ascend in both texts."""
    tree: list[tuple[int, int]] = [(0, -1)] * (n_words + 1)
    back = []
    # cells of one place of the document come with the last place of the item first, so that they don't follow each other
    cells = sorted(cells, key=lambda c: (c[0], -c[1], -c[2]))
    for i, (_, q, words, *_) in enumerate(cells):
        best, at = (0, -1), q
        while at:
            best, at = max(best, tree[at]), at & (at - 1)
        back.append(best[1])
        best, at = (best[0] + words, i), q + words
        while at <= n_words:
            tree[at], at = max(tree[at], best), at + (at & -at)
    best, at = (0, -1), n_words
    while at:
        best, at = max(best, tree[at]), at & (at - 1)
    out, i = [], best[1]
    while i >= 0:
        out.append(cells[i])
        i = back[i]
    return out


def _consistent(cells: list[tuple]) -> list[tuple]:
    """The cells whose item value stands for the document value that it has most often there."""
    votes: dict[int, dict[int, dict[int, int]]] = {}
    for p, q, words, value, meant in cells:
        if value:
            votes.setdefault(value, {}).setdefault(meant, {}).setdefault(q, p)
    chosen = {v: max(m, key=lambda x: (len(m[x]), -min(m[x].values()))) for v, m in votes.items()}
    return [c for c in cells if not c[3] or chosen[c[3]] == c[4]]


def covered_words(cells: set[tuple], n_words: int, share: float) -> int:
    """Words of an item that an ascending and consistent chain of cells covers."""
    literal = {c[:3] for c in cells if not c[3]}
    cells = [c for c in cells if not c[3] or c[:3] not in literal]
    near: dict[int, list] = {}
    for c in cells:
        shift = c[0] - c[1]
        for band in (shift // (2 * DRIFT) * 2, (shift + DRIFT) // (2 * DRIFT) * 2 + 1):
            near.setdefault(band, []).append(c)
    best = 0
    for own in [cells, *near.values()]:
        reach = set()
        for _, q, words, *_ in own:
            reach.update(range(q, q + words))
        if len(reach) > best and len(reach) >= share * n_words - 1e-9:
            for chain in (_chain(_consistent(own), n_words), _consistent(_chain(own, n_words))):
                best = max(best, sum(c[2] for c in chain))
    return best


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, n_words, at, hash, slots, places, lens) of every template window of the items."""
    schema = "item long, n_words int, at int, hash long, slots array<long>, places array<int>, lens array<int>"

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                items = piece.column("item").to_numpy(zero_copy_only=False)
                offsets = canonical(piece.column("text"))[3]
                for w in windows(piece.column("text"), width):
                    text, at, hashes, *lists = _rows(*w, np.ones(len(w[0]), bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(items[text], pa.int64()), pa.array(np.diff(offsets)[text], pa.int32()), pa.array(at), pa.array(hashes), *lists],
                        names=["item", "n_words", "at", "hash", "slots", "places", "lens"],
                    )

    return benchmark.mapInArrow(run, schema)


def _hits(docs: DataFrame, known: np.ndarray, width: int) -> DataFrame:
    """Template windows of docs (doc, text_hash, text) whose hash is in the sorted array `known`."""
    known = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        hashes = known.value
        for batch in batches:
            for piece in slices(batch):
                for w in windows(piece.column("text"), width):
                    near = np.minimum(np.searchsorted(hashes, w[2]), len(hashes) - 1)
                    keep = np.flatnonzero(hashes[near] == w[2])
                    if len(keep):
                        text, at, own, slots, places, _ = _rows(*w, keep)
                        text = pa.array(text)
                        yield pa.RecordBatch.from_arrays([piece.column("doc").take(text), piece.column("text_hash").take(text), pa.array(at), pa.array(own), slots, places], names=["doc", "text_hash", "at", "hash", "slots", "places"])

    return docs.mapInArrow(run, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """(doc, text_hash, item, covered) of the texts that hold an item; docs has (doc_id, text), benchmark (item_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    items = scratch.save(benchmark_windows(items, width), "windows").dropDuplicates(["item", "at", "hash"])

    distinct = scratch.save(items.select("hash").distinct(), "hashes")
    passes = max(1, -(-distinct.count() // HASHES))
    for i in range(passes):
        part = distinct.where(F.pmod("hash", F.lit(passes)) == i) if passes > 1 else distinct
        known = np.sort(part.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        if len(known):
            _hits(docs, known, width).write.mode("append").parquet(f"{scratch.path}/hits")
    if not distinct.isEmpty():
        hits = docs.sparkSession.read.schema(HITS).parquet(f"{scratch.path}/hits")
    else:
        hits = docs.sparkSession.createDataFrame([], HITS)

    met = hits.join(items.withColumnsRenamed({"at": "item_at", "slots": "item_slots", "places": "item_places"}), "hash")
    # spans of the document, each of which shares a half with the next: what is within SPAN items is in one
    span = F.floor(F.col("at") / (SPAN * F.col("n_words")))
    met = met.withColumn("span", F.explode(F.array(span, span - 1))).where("span >= 0")
    place = ["doc", "text_hash", "item", "n_words", "span"]
    cells = F.collect_set(F.struct("places", "item_places", "lens", "item_slots", "slots")).alias("cells")
    grouped = met.groupBy(*place).agg(F.sum(F.expr("aggregate(lens, 0, (x, y) -> x + y)")).alias("most"), cells).where(F.col("most") >= share * F.col("n_words") - 1e-9)

    def run(batches):
        for batch in batches:
            counts = []
            for n_words, windows in zip(batch.column("n_words").to_pylist(), batch.column("cells"), strict=True):
                own = {c for w in windows.as_py() for c in zip(*w.values(), strict=True)}
                counts.append(covered_words(own, n_words, share))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "text_hash", "item", "n_words")), pa.array(counts, pa.int32())], names=["doc", "text_hash", "item", "n_words", "n"])

    agreed = grouped.select("doc", "text_hash", "item", "n_words", "cells").mapInArrow(run, "doc long, text_hash long, item long, n_words int, n int")
    held = agreed.withColumn("covered", F.col("n") / F.col("n_words")).where(F.col("covered") >= share)
    best = held.groupBy("doc", "text_hash").agg(F.max(F.struct("covered", (-F.col("item")).alias("least"))).alias("best"))
    return scratch.save(best.select("doc", "text_hash", (-F.col("best.least")).alias("item"), F.least("best.covered", F.lit(1.0)).alias("covered")), "found")


def judge(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, **how) -> DataFrame:
    """(doc_id, contaminated, item_id, covered) of every row of docs."""
    found = contaminated(docs, benchmark, share, **how)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(found, keyed.doc_id.eqNullSafe(found.doc) & (keyed.text_hash == found.text_hash), "left")
    return joined.select("doc_id", F.col("item").isNotNull().alias("contaminated"), F.col("item").alias("item_id"), "covered")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, **how) -> DataFrame:
    """The rows of docs that hold no item."""
    found = contaminated(docs, benchmark, share, **how)
    same = F.col("doc_id").cast("long").eqNullSafe(found.doc) & (F.xxhash64("text") == found.text_hash)
    return docs.join(found, same, "left_anti")
