"""Line deduplication: near copies of lines by MinHash.

A line's set holds the hashes of its distinct character shingles. The hash domain is a circle; a window is as many
hashes that follow one another from some place on, which two lines share with about that power of their similarity.
Lines of more than SMALL shingles are signed by windows of ROWS hashes from BANDS fixed places on: lines that are not
alike hardly ever meet, and of links at similarity 0.8 about 5 in 1,000 are missed, at 0.85 next to none. Lines of at
most SMALL / 0.8 shingles are signed by all of their windows of 4: sets that differ in d elements have at least 4.5 d
of them at similarity 0.8, and each difference spoils 4 windows at most, so of links between small sets none is
missed. Lines that agree in a window are candidates. They are verified by exact arithmetic on the whole sets and linked
lines are united; of each component the first occurrence, by document and line, stays.

Signatures are packed by bucket and shuffled as bytes; a bucket tells which of them two lines have, and only the lines
that have one are candidates, whose text is shuffled. Equal lines are one row before any join. A window's group is not
expanded into pairs: in ROUNDS rounds one leader of each group, the member whose hash comes first, is compared with
the others and leaves the group; groups whose members share one component are settled. The rest is cut into tiles of
bounded size, and pairs of tiles are compared as cells, first by sketches of a few bits an element, then by products
of incidence matrices, of which only the edges of a spanning forest come out.

Lines are split, hashed, grouped and joined by DataFrame functions. Sets are made and compared with numpy in Arrow
batches: in DataFrame functions, which interpret a lambda for every shingle, they took five times the time allowed.

Defined results: lines end at line feeds; blank lines (spaces, tabs and carriage returns at most) stay where they
are and are compared with nothing. A line shorter than a shingle has only equal copies. Equal lines are known by
two 64-bit hashes; different lines that share the first one are compared with nothing. Shingles are known by 53 bits
or more. A null text stays null and has no lines. Rows that repeat an id keep and lose the same lines. A null id comes
before all others. An empty table gives no rows. Extra columns are carried, whatever their names, but for n_lines and
n_removed, which are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, connected_components, renamed, small_batches, unsettled
from millrace.llm.jaccard_join import HELD, OWN, SIG, _cut, forests, shared_signatures, sketch, tiled
from millrace.llm.textops import mix, odd_factors, whole

BANDS, ROWS, SMALL, SMALL_ROWS, ROUNDS = 30, 8, 40, 4, 2
#: Lines and bytes that are worked on at once; bits of a shingle's hash beside the line's number.
LINES, BYTES, BITS = 1_000, 1 << 20, 54


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h) of every line that isn't blank."""
    found = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return found.where(F.col("line").rlike(r"[^ \t\r]")).withColumn("h", F.xxhash64("line"))


def _runs(batch: pa.RecordBatch, *columns: str):
    """The batch in runs of LINES rows and about BYTES bytes of the columns at most (a longer row is a run of its own)."""
    total = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < len(total):
        end = min(at + LINES, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def characters(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all lines, each by its bytes, and the offsets of the lines among them."""
    lines = whole(lines)
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(lines) + 1]
    raw = np.frombuffer(data, np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    if not (raw & 0x80).any():
        return raw.astype(np.uint64), at
    first = (raw & 0xC0) != 0x80
    first[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first)
    width = np.diff(np.append(starts, len(raw)))
    padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint64)
    found = padded[starts]
    for i in range(1, 4):
        found |= np.where(width > i, padded[starts + i], np.uint64(0)) << np.uint64(8 * i)
    return found, np.concatenate([[0], np.cumsum(first)])[at]


def shingle_keys(lines: pa.Array, width: int, names: np.ndarray, bits: int) -> np.ndarray:
    """A key for each shingle of each line: the line's name, then `bits` bits of the shingle's hash. A line shorter than a
    shingle has none."""
    found, at = characters(lines)
    if len(found) < width:
        return np.zeros(0, np.uint64)
    line = np.repeat(names, np.diff(at)).astype(np.uint64)
    place = np.repeat(np.arange(len(names)), np.diff(at))
    n = len(found) - width + 1
    h = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_factors(width)):
        h += found[i : i + n] * factor
    own = place[:n] == place[width - 1 :]
    return (line[:n][own] << np.uint64(bits)) | (mix(h[own]) >> np.uint64(64 - bits))


def unique_sorted(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def windows(lines: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size of each line's set, and the signatures of all lines with their offsets."""
    keys = unique_sorted(shingle_keys(lines, width, np.arange(len(lines)), BITS))
    lo = np.searchsorted(keys, np.arange(len(lines) + 1, dtype=np.uint64) << np.uint64(BITS))
    lo, n = lo[:-1], np.diff(lo)
    large = np.flatnonzero(n > SMALL)
    places = np.arange(BANDS, dtype=np.uint64) * np.uint64(2**BITS // BANDS)
    at = np.searchsorted(keys, (large.astype(np.uint64)[:, None] << np.uint64(BITS)) + places).ravel()
    small = np.flatnonzero(np.repeat(4 * n <= 5 * SMALL, n))
    values = mix(keys & np.uint64(2**BITS - 1))
    line, sig = [], []
    for own, first, rows in ((np.repeat(large, BANDS), at, ROWS), (np.repeat(np.arange(len(lines)), n)[small], small, SMALL_ROWS)):
        total = np.full(len(own), rows, np.uint64)
        for i in range(rows):
            full = i < n[own]
            total[full] += values[(lo[own] + (first - lo[own] + i) % np.maximum(n[own], 1))[full]]
        line.append(own)
        sig.append(mix(total))
    line, sig = np.concatenate(line), np.concatenate(sig)
    order = np.lexsort((sig, line))
    line, sig = line[order], sig[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (sig[1:] != sig[:-1])
    return n, sig[new], np.searchsorted(line[new], np.arange(len(lines) + 1))


def signature_blobs(lines: DataFrame, width: int, buckets: int) -> DataFrame:
    """The windows of lines (h, line) by bucket: (bucket, sigs, owners), SIG and OWN bytes each; an owner is the end of h."""

    def run(batches):
        for batch in batches:
            for part in _runs(batch, "line"):
                h, first = np.unique(part.column("h").to_numpy(), return_index=True)
                _, sig, offsets = windows(part.column("line").take(pa.array(first)), width)
                owner = np.repeat(h, np.diff(offsets))
                bucket = ((sig >> np.uint64(8 * SIG)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner, bucket = _cut(sig[order], SIG), _cut(owner[order], OWN), bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = list(zip(starts, np.append(starts[1:], len(bucket)), strict=True))
                columns = [pa.array(bucket[starts], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (sig, owner))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "sigs", "owners"])

    return lines.select("h", "line").mapInArrow(run, "bucket long, sigs binary, owners binary")


def sized(texts: DataFrame, width: int) -> DataFrame:
    """(node, line, n) of lines (node, line), n the size of the set."""

    def run(batches):
        for batch in batches:
            for part in _runs(batch, "line"):
                keys = unique_sorted(shingle_keys(part.column("line"), width, np.arange(len(part)), BITS))
                n = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("line"), pa.array(n)], names=["node", "line", "n"])

    return texts.select("node", "line").mapInArrow(run, "node long, line string, n long")


def _once(value: F.Column, use) -> F.Column:
    """use(value), with the value computed once, however often and wherever it is used: a column of a select may be put
    in place of its name, in a filter or inside a lambda that runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def common(x: pa.Array, y: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of x and of y, and of the intersection of each x with its y. Both sides are sorted as one: the
    last bit of a key tells the side, so what is common lies side by side."""
    names, side = np.arange(len(x)), np.uint64(1)
    keys = [shingle_keys(z, width, names, BITS - 1) << side for z in (x, y)]
    keys = unique_sorted(np.concatenate([keys[0], keys[1] | side]))
    row, of_y = (keys >> np.uint64(BITS)).astype(np.int64), (keys & side).astype(bool)
    twin = (keys[1:] ^ keys[:-1]) == side
    return (np.bincount(r, minlength=len(x)) for r in (row[~of_y], row[of_y], row[1:][twin]))


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The components (a, b) of the pairs (node, lead, component, c_lead) of lines that link."""
    sides = [texts.select(F.col("node").alias(c), F.col("line").alias(f"{c}_line")) for c in ("node", "lead")]
    both = pairs.join(sides[0], "node").join(sides[1], "lead").select("component", "c_lead", "node_line", "lead_line")

    def run(batches):
        for batch in batches:
            for part in _runs(batch, "node_line", "lead_line"):
                m, n, both = common(part.column("node_line"), part.column("lead_line"), width)
                linked = pa.array(den * both >= num * (m + n - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(linked) for c in ("component", "c_lead")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, elements, sketch) of lines (node, line)."""

    def run(batches):
        for batch in batches:
            for part in _runs(batch, "line"):
                keys = unique_sorted(shingle_keys(part.column("line"), width, np.arange(len(part)), BITS))
                offsets = np.searchsorted(keys, np.arange(len(part) + 1, dtype=np.uint64) << np.uint64(BITS))
                keys &= np.uint64(2**BITS - 1)
                sketches = pa.array([sketch(keys[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                elements = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(offsets)), elements, sketches], names=["node", "n", "elements", "sketch"])

    return texts.select("node", "line").mapInArrow(run, "node long, n long, elements array<long>, sketch binary")


def line_components(live: DataFrame, texts: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """Components (node, component) of the links among lines that share a group (sig, node, n); None without links.
    n is the size of a line's set."""
    live, merges = live.withColumn("component", F.col("node")), []

    def merged(edges: DataFrame, label: str) -> bool:
        edges = scratch.save(edges, label)
        found = not edges.isEmpty()
        if found:
            merges.append(connected_components(edges, scratch, f"{label}-cc"))
        scratch.drop(label)
        return found

    for i in range(ROUNDS):
        if live.isEmpty():
            break
        first = F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("place"), "node", "n", "component"))
        lead = live.groupBy("sig").agg(first.alias("m")).select("sig", F.col("m.node").alias("lead"), F.col("m.n").alias("n_lead"), F.col("m.component").alias("c_lead"))
        met = scratch.save(live.join(lead, "sig").where("node <> lead"), f"met-{i}")
        near = f"component <> c_lead AND {den}L * least(n, n_lead) >= {num}L * greatest(n, n_lead)"
        pairs = met.where(near).select("node", "lead", "component", "c_lead").distinct()
        found = merged(verified(pairs, texts, width, num, den), f"led-{i}")
        rest = met.drop("lead", "n_lead", "c_lead")
        live = scratch.save(unsettled(renamed(rest, merges[-1]) if found else rest), f"groups-{i}")
        scratch.drop(f"met-{i}", f"groups-{i - 1}")
    if not live.isEmpty():
        sets = scratch.save(sets_of(texts.join(live.select("node").distinct(), "node", "left_semi"), width), "sets")
        merged(forests(tiled(live, "sig"), sets, num, den), "rest")
        scratch.drop("sets")
    if not merges:
        return None
    nodes = reduce(DataFrame.unionByName, [m.select("node") for m in merges]).distinct().withColumn("component", F.col("node"))
    return scratch.save(reduce(renamed, merges, nodes), "components")


def duplicate_lines(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, line_no) of every line that goes: all of a component but its first occurrence."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    twin = F.xxhash64(F.lit(1), "line").alias("h2")
    each = lines_of(docs).select("h", twin, F.struct("doc_id", "line_no").alias("at"))
    distinct = scratch.save(each.groupBy("h", "h2").agg(F.min("at").alias("at"), F.count("*").alias("many")), "distinct")

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(3 * partitions, distinct.count() * (BANDS + SMALL // 4) // HELD + 1)
    shared = scratch.save(shared_signatures(signature_blobs(lines_of(docs), width, buckets).repartition(buckets, "bucket")), "shared")
    nodes = distinct.select(F.col("h").alias("node"), F.expr(f"h & {(1 << 8 * OWN) - 1}L").alias("owner")).distinct()
    live = shared.join(nodes, "owner").select("sig", "node").distinct()
    candidates = live.select(F.col("node").alias("h")).distinct()
    texts = lines_of(docs).select("h", "line").join(candidates, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"), F.max("line").alias("last"))
    texts = scratch.save(sized(texts.where("line = last").select(F.col("h").alias("node"), "line"), width), "texts")
    live = scratch.save(live.join(texts.select("node", "n"), "node"), "live")
    scratch.drop("shared")
    components = line_components(live, texts, width, num, den, scratch)
    scratch.drop("live", "texts")

    known = distinct.select("h", "h2", "at", "many")
    if components is not None:
        known = known.join(components.select(F.col("node").alias("h"), "component"), "h", "left")
    else:
        known = known.withColumn("component", F.lit(None).cast("long"))
    known = known.where("many > 1 OR component IS NOT NULL").withColumn("twin", F.when(F.col("component").isNull(), F.col("h2"))).withColumn("component", F.coalesce("component", "h"))
    known = scratch.save(known, "known")
    kept = known.groupBy("component", "twin").agg(F.min("at").alias("keep"))
    verdict = known.join(kept, (known.component == kept.component) & known.twin.eqNullSafe(kept.twin)).select("h", "h2", "keep")
    verdict = scratch.save(verdict, "verdict")
    scratch.drop("known", "distinct")
    occurrences = lines_of(docs).select("doc_id", "line_no", "h", twin)
    gone = occurrences.join(verdict, ["h", "h2"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keep")))
    return scratch.save(gone.select("doc_id", "line_no"), "gone")


def dedup_lines(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """docs with the lines that stay as `text`, and `n_lines` and `n_removed` counts at the end."""
    gone = duplicate_lines(docs, width, num, den, scratch)
    gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("whole"))
    joined = rows.join(gone, rows.id.eqNullSafe(gone.doc_id), "left")
    parts = F.split("whole", "\n", -1)
    stay = _once(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "gone"), lambda i: F.get(p, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(stay)
    counts = [F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")]
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], *counts)
