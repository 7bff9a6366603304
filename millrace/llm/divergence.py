"""Source divergence audit: how far the word use of each source of a language lies from the others'.

Each task counts the terms of its documents in radix tries over bytes, one a language, whose leaves count documents
and, for each source, occurrences. A trie lies depth first: a leaf has the depth at which it branches off the leaf
before it, and the bytes from there on, so a walk along the arrays gives the leaves in UTF-8 order. Tries are merged
by range of prefixes: they are written in segments, a bounded sample of the segments' first terms gives the ranges'
bounds, segments are cut there, and in each range the segments, sorted by their first terms, are merged as they
stream by; what lies before the next segment's first term is final. Terms of too few documents go, the others become
blocks of leaves. A last walk over the blocks, in UTF-8 order, adds up what each pair of sources differs by and
streams each source's candidates, whose ties keep the order of the walk.

With c the count of a term, n all counts and v the kept terms, p = 1 + floor(10**9 * (c + 1) / (n + v)), and the
divergence of a term is floor((p - q)**2 / q). Terms that neither source of a pair has differ by the same amount, so
the walk adds what the others differ by beyond it. Whole numbers throughout: products of counts go digit by digit
where they would pass 64 bits; sums stay below 2**63 for fewer than 8 * 10**9 kept terms.

Defined results: a null text, language or source is empty. A task's tries are written out when they hold `limit`
counters, so memory holds at any number of terms; a term may be as long as a text. Rows that repeat an id are
documents of their own. A language without kept terms has pairs of value 0 and no terms; a source without a document
of its own terms takes part with counts of 0. An empty table gives no rows. The sources of a language take a table of
pairs in a task, as the result has a row for each pair. Columns besides the text, language and source are ignored.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, small_batches
from millrace.llm.textops import slices, whole

#: Counters that a task's tries hold before they go out, leaves of a segment and of a block, and bytes of its terms.
LIMIT, SEGMENT, BLOCK, BLOCK_BYTES = 1_000_000, 4_096, 2_048, 4 << 20
#: Leaves of a range, ranges at most, sampled segments for each, bytes of a bound.
RANGE, RANGES, SAMPLED, BOUND = 250_000, 4_096, 32, 64
SALT, SCALE = 16, 10**9
SEGMENT_DDL = "lang string, first binary, last binary, n int, depth binary, edge_ends binary, edges binary, docs binary, at binary, names array<string>, source binary, counts binary"
BLOCK_DDL = "lang string, salt int, n long, terms array<binary>, at binary, names array<string>, source binary, counts binary, sums array<struct<source: string, n: long>>"
FOUND_DDL = "lang string, source string, item string, value long, kind int"

#: What each byte becomes, and whether terms hold it: ASCII letters and all of other characters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


class Leaves(NamedTuple):
    """Leaves in the order of their terms: documents, and at[i] to at[i + 1] the counters (source, count) of leaf i."""

    terms: pa.Array
    docs: np.ndarray
    at: np.ndarray
    source: np.ndarray
    counts: np.ndarray

    def cut(self, lo: int, hi: int) -> Leaves:
        a, b = int(self.at[lo]), int(self.at[hi])
        return Leaves(self.terms.slice(lo, hi - lo), self.docs[lo:hi], self.at[lo : hi + 1] - a, self.source[a:b], self.counts[a:b])

    def only(self, kept: np.ndarray) -> Leaves:
        n = np.diff(self.at)
        own = np.repeat(kept, n)
        return Leaves(self.terms.filter(pa.array(kept)), self.docs[kept], np.concatenate([[0], np.cumsum(n[kept])]), self.source[own], self.counts[own])


def merged(parts: list[Leaves], sources: int) -> Leaves:
    """The leaves of all parts, equal ones added up."""
    coded = pa.concat_arrays([p.terms for p in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    leaf = place[coded.indices.to_numpy()]
    docs = np.zeros(len(order), np.int64)
    np.add.at(docs, leaf, np.concatenate([p.docs for p in parts]))
    key = np.repeat(leaf, np.concatenate([np.diff(p.at) for p in parts])) * sources + np.concatenate([p.source for p in parts])
    counts = np.concatenate([p.counts for p in parts])
    by = np.argsort(key, kind="stable")
    key, counts = key[by], counts[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(counts, starts) if len(starts) else counts
    key = key[starts]
    return Leaves(coded.dictionary.take(order), docs, np.searchsorted(key, np.arange(len(order) + 1) * sources), key % sources, sums)


def depths(terms: pa.Array) -> np.ndarray:
    """The depth at which each term branches off the one before it: the bytes that both begin with."""
    _, offsets, data = terms.buffers()
    at = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    found = np.zeros(len(terms), np.int64)
    most = np.minimum(np.diff(at)[1:], np.diff(at)[:-1])
    live = np.arange(1, len(terms))
    while len(live):
        live = live[found[live] < most[live - 1]]
        live = live[raw[at[live] + found[live]] == raw[at[live - 1] + found[live]]]
        found[live] += 1
    return found


def trie(lang: str, leaves: Leaves, names: list[str]) -> dict:
    """A trie, depth first, as a row of SEGMENT_DDL."""
    _, offsets, data = leaves.terms.buffers()
    at = np.frombuffer(offsets, np.int64)[leaves.terms.offset : leaves.terms.offset + len(leaves.terms) + 1]
    depth = depths(leaves.terms)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    inside = np.arange(at[0], at[-1]) - np.repeat(at[:-1] + depth, np.diff(at)) >= 0
    ends = np.cumsum(np.diff(at) - depth)
    used = np.unique(leaves.source)
    return {
        "lang": lang, "first": leaves.terms[0].as_py(), "last": leaves.terms[-1].as_py(), "n": len(leaves.terms), "depth": depth.astype("<i4").tobytes(), "edge_ends": ends.astype("<i8").tobytes(), "edges": raw[inside].tobytes(),
        "docs": leaves.docs.astype("<i8").tobytes(), "at": leaves.at.astype("<i8").tobytes(), "names": [names[i] for i in used], "source": np.searchsorted(used, leaves.source).astype("<i4").tobytes(), "counts": leaves.counts.astype("<i8").tobytes(),
    }


def walk(row: dict, names: dict[str, int]) -> Leaves:
    """The leaves of a trie in UTF-8 order. names: the sources that are known so far, with their numbers."""
    ends, edges = np.frombuffer(row["edge_ends"], "<i8").tolist(), row["edges"]
    path, lo, terms = b"", 0, []
    for depth, hi in zip(np.frombuffer(row["depth"], "<i4").tolist(), ends, strict=True):
        path = path[:depth] + edges[lo:hi]
        terms.append(path)
        lo = hi
    numbers = np.array([names.setdefault(s, len(names)) for s in row["names"]], np.int64)
    return Leaves(pa.array(terms, pa.large_binary()), np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["at"], "<i8"), numbers[np.frombuffer(row["source"], "<i4")], np.frombuffer(row["counts"], "<i8"))


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    kinds["array<struct<source: string, n: long>>"] = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    fields = [(*f.split(" ", 1),) for f in ddl.replace("source: string, n:", "source: string; n:").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind.replace(";", ",")]) for name, kind in fields], names=[name for name, _ in fields])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, A-Z lower-cased, and the text of each."""
    texts = whole(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    inside = IN_TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[raw[inside]])]), np.searchsorted(at, starts, side="right") - 1


def _counted(batch: pa.RecordBatch, names: dict[str, int]) -> dict[str, Leaves]:
    """The leaves of each language in a batch."""
    terms, text = terms_of(batch.column("text"))
    if not len(terms):
        return {}
    langs, sources = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
    source = np.array([names.setdefault(s, len(names)) for s in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()]
    lang = langs.indices.to_numpy()
    coded = terms.dictionary_encode()
    # occurrences of each term in each text
    key, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(batch) + text, return_counts=True)
    code, text = key // len(batch), key % len(batch)
    found = {}
    for i, name in enumerate(langs.dictionary.to_pylist()):
        own = lang[text] == i
        here, docs = np.unique(code[own], return_counts=True)
        if len(here):
            found[name] = Leaves(coded.dictionary.take(pa.array(here)), docs, np.concatenate([[0], np.cumsum(docs)]), source[text[own]], n[own])
    return found


def _tries(limit: int):
    """The tries of a task in segments; they go out when they hold `limit` counters."""

    def run(batches):
        parts: dict[str, list[Leaves]] = {}
        names: dict[str, int] = {}

        def out():
            for lang, own in parts.items():
                leaves = merged(own, len(names))
                for lo in range(0, len(leaves.terms), SEGMENT):
                    yield _batch([trie(lang, leaves.cut(lo, min(lo + SEGMENT, len(leaves.terms))), [*names])], SEGMENT_DDL)

        held, least = 0, limit
        for batch in batches:
            for piece in slices(batch):
                for lang, leaves in _counted(piece, names).items():
                    parts.setdefault(lang, []).append(leaves)
                    held += len(leaves.counts)
                if held >= least:
                    parts = {lang: [merged(own, len(names))] for lang, own in parts.items()}
                    held = sum(len(own[0].counts) for own in parts.values())
                    if held >= limit:
                        yield from out()
                        parts, held = {}, 0
                    # what has been merged is merged again when as much has come
                    least = held + limit
        yield from out()

    return run


def _bounds(segments: DataFrame, per_range: int) -> list[tuple[str, bytes]]:
    """Bounds of the ranges, from a sample of the segments' first terms of bounded size."""
    n, leaves = segments.agg(F.count("*"), F.sum("n")).first()
    ranges = min(RANGES, -(-(leaves or 0) // per_range))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLED * ranges / n)
    drawn = segments.where(F.pmod(F.xxhash64("lang", "first", "last", "edges"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    keys = sorted((r[0], bytes(r[1])) for r in drawn.select("lang", F.substring("first", 1, BOUND)).limit(2 * SAMPLED * RANGES).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _cut(bounds: list[tuple[str, bytes]]):
    """Segments, cut at the bounds, with the number of their range."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lo, hi = (bisect.bisect_right(bounds, (row["lang"], row[c])) for c in ("first", "last"))
                if lo == hi:
                    rows.append(row | {"range": lo})
                    continue
                names: dict[str, int] = {}
                leaves = walk(row, names)
                terms = leaves.terms.to_pylist()
                cuts = [0, *(bisect.bisect_left(terms, b) for _, b in bounds[lo:hi]), len(terms)]
                rows += [trie(row["lang"], leaves.cut(a, b), [*names]) | {"range": lo + i} for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield _batch(rows, f"{SEGMENT_DDL}, range int")

    return run


def _blocks(least: int):
    """Blocks of the leaves with `least` documents or more; segments come by range, language and first term."""

    def run(batches):
        at, names, held, block, made = None, {}, [], [], 0

        def packed(final: bool):
            nonlocal block, made
            if not block:
                return
            leaves = merged(block, len(names)) if len(block) > 1 else block[0]
            size = np.cumsum(pc.binary_length(leaves.terms).to_numpy() + 12 * np.diff(leaves.at))
            lo = 0
            while lo < len(size) and (final or len(size) - lo >= BLOCK):
                hi = min(lo + BLOCK, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK_BYTES))), len(size))
                own, known = leaves.cut(lo, hi), [*names]
                sums = np.zeros(len(known), np.int64)
                np.add.at(sums, own.source, own.counts)
                made += 1
                yield _batch([{"lang": at[1], "salt": made % SALT, "n": hi - lo, "terms": own.terms.to_pylist(), "at": own.at.astype("<i8").tobytes(), "names": known, "source": own.source.astype("<i4").tobytes(), "counts": own.counts.astype("<i8").tobytes(), "sums": [{"source": s, "n": int(x)} for s, x in zip(known, sums, strict=True) if x]}], BLOCK_DDL)
                lo = hi
            block = [leaves.cut(lo, len(size))] if lo < len(size) else []

        def settled(before: bytes | None):
            """What lies before this term is final."""
            nonlocal held
            leaves = merged(held, len(names))
            end = len(leaves.terms) if before is None else bisect.bisect_left(leaves.terms.to_pylist(), before)
            done = leaves.cut(0, end)
            block.append(done.only(done.docs >= least))
            held = [leaves.cut(end, len(leaves.terms))]

        grown = 0
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["range"], row["lang"]):
                    if held:
                        settled(None)
                        yield from packed(True)
                    at, names, held, grown = (row["range"], row["lang"]), {}, [], 0
                elif grown >= 64 * SEGMENT:
                    settled(row["first"])
                    yield from packed(False)
                    grown = 0
                held.append(walk(row, names))
                grown += row["n"]
        if held:
            settled(None)
            yield from packed(True)

    return run


def weights(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), of whole numbers with count + 1 <= total, exactly."""
    counts, total = np.broadcast_arrays(np.asarray(counts, np.int64) + 1, np.asarray(total, np.int64))
    most = int(total.max(initial=1))
    base = next(b for b in (10**9, 10**3, 10) if most <= (2**63 - 1) // b)
    found, rest, scale = np.zeros(total.shape, np.int64), counts, 1
    while scale < SCALE:
        digit, rest = np.divmod(rest * base, total)
        found, scale = found * base + digit, scale * base
    return found + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _walked(most: int):
    """Partial sums of pairs (kind 0) and a source's candidates (kind 1) of the blocks that a task walks over, for each
    block with the sources of its language, their counts and the number of kept terms."""

    def run(batches):
        sums: dict[str, tuple] = {}
        best: dict[tuple[str, str], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lang, sources, terms = row["lang"], row["sources"], row["terms"]
                number = {s: i for i, s in enumerate(sources)}
                total = np.array(row["totals"], np.int64) + row["kept"]
                if lang not in sums:
                    sums[lang] = sources, np.zeros((len(sources), len(sources)), np.int64)
                c = np.zeros((len(terms), len(sources)), np.int64)
                numbers = np.array([number[s] for s in row["names"]], np.int64)
                c[np.repeat(np.arange(len(terms)), np.diff(np.frombuffer(row["at"], "<i8"))), numbers[np.frombuffer(row["source"], "<i4")]] = np.frombuffer(row["counts"], "<i8")
                p, none = weights(c, total[None, :]), weights(np.zeros(len(sources), np.int64), total)
                beyond = differ(none[:, None], none[None, :])
                q = weights(c.sum(axis=1), np.array(sum(row["totals"]) + row["kept"]))
                for a, name in enumerate(sources):
                    has = np.flatnonzero(c[:, a])
                    if not len(has):
                        continue
                    own, others = p[has, a][:, None], p[has]
                    sums[lang][1][a] += (differ(own, others) - beyond[a]).sum(axis=0)
                    sums[lang][1][:, a] += np.where(c[has] == 0, differ(others, own) - beyond[:, a], 0).sum(axis=0)
                    over = has[p[has, a] > q[has]]
                    value = differ(p[over, a], q[over])
                    first = np.argsort(-value, kind="stable")[:most]
                    kept = best.setdefault((lang, name), [])
                    kept += [(-int(v), terms[i]) for v, i in zip(value[first], over[first], strict=True)]
                    if len(kept) > 8 * most:
                        kept.sort()
                        del kept[most:]
        for lang, (sources, pairs) in sums.items():
            for a, name in enumerate(sources):
                yield _found(lang, name, [(s, int(v), 0) for s, v in zip(sources, pairs[a], strict=True) if s != name])
        for (lang, name), kept in best.items():
            yield _found(lang, name, [(t.decode(errors="replace"), -v, 1) for v, t in sorted(kept)[:most]])

    return run


def _found(lang: str, source: str, rows: list[tuple]) -> pa.RecordBatch:
    item, value, kind = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([source] * len(rows), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64()), pa.array(kind, pa.int32())], names=["lang", "source", "item", "value", "kind"])


def divergence(docs: DataFrame, least: int = 3, most: int = 200, limit: int = LIMIT, per_range: int = RANGE, scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language by divergence from
    it, part `term` the `most` terms that the source has more of than its language."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "divergence")
    small_batches(spark)
    docs = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    segments = scratch.save(docs.mapInArrow(_tries(limit), SEGMENT_DDL), "segments")
    bounds = _bounds(segments, per_range)
    cut = segments.mapInArrow(_cut(bounds), f"{SEGMENT_DDL}, range int")
    dealt = cut.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang", "first")
    blocks = scratch.save(dealt.mapInArrow(_blocks(least), BLOCK_DDL), "blocks")
    scratch.drop("segments")

    # every group, with its counts of kept terms
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = blocks.select("lang", F.explode("sums").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    kept = blocks.groupBy("lang").agg(F.sum("n").alias("kept"))
    groups = groups.join(counted, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    groups = scratch.save(groups, "groups")

    shape = groups.groupBy("lang", "kept").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("s"))
    shape = shape.select("lang", "kept", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = scratch.save(blocks.join(shape, ["lang", "salt"]).mapInArrow(_walked(most), FOUND_DDL), "found")

    # what terms that neither has differ by, for all kept terms
    none = groups.withColumn("p", F.expr(f"1 + {SCALE} div greatest(total + kept, 1)"))
    other = none.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    base = none.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr("kept * ((p - q) * (p - q) div q)").alias("value"))
    pairs = base.unionByName(found.where("kind = 0").drop("kind")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    terms = found.where("kind = 1").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(best).alias("rank")).where(F.col("rank") <= most)
    return pairs.unionByName(terms)
