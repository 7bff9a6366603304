"""N-gram Jaccard join by PartEnum signatures: the components of all links at or above a similarity, and each
document's number of links.

A document's set holds the hashes of its distinct word shingles. Sets fall into size bands; two sets whose
Jaccard similarity is at least num/den lie in the same or in neighbouring bands and differ in at most k
elements, k from the band alone. PartEnum cuts the hash domain into n1 parts, so that two similar sets differ in at
most k2 elements in some of them, and each part into n2 smaller ones, of which all subsets of n2 - k2 are signed:
in a part with few differences one of those subsets has none. `plan` chooses n1, n2 and k2 for each k. There are
`need` - 1 more parts than the pigeonhole principle asks for, so that similar sets share `need` signatures at
least; sets that share fewer with all others have no links and leave before anything is compared.

Copies (equal sets) collapse first. A signature's group is not expanded into pairs: each group has a leader, the
member of the most groups, and the sets that share a group with a leader form its ball, which holds the group.
Balls are cut into cells of bounded size. In a cell, sketches of a few bits an element tell which sets may link at
all, and these are compared as products of incidence matrices; of a cell only the edges of a spanning forest come out. Balls of several cells are compared with their leader and inside
each cell first; of those whose sets are still in several components then, the sets that share enough groups with
such leaders are compared in all pairs of cells.
Exact set arithmetic decides. All links lie inside the components that this finds and are counted there, in cells
as well: rows grow with the size of a component over TILE, and only arithmetic with its square.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own
component. Rows with a null id take no part and give no row. Repeated rows of one id count as one document
whose set is that of its smallest representation. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, connected_components, renamed, small_batches, unsettled
from millrace.llm.textops import hash_strings, mix, salt, shingles, slices, split_words

#: Signatures that any set may have in a band; elements that may differ for each signature more that similar sets
#: must share.
LEAST, SPARE = 24, 12
#: Sets and elements that a cell should hold on a side, and columns of an incidence matrix.
TILE, TILE_ELEMENTS, COLUMNS = 512, 1_000_000, 4_096
#: Rows of signatures that a task should hold, copies that it knows, and bytes of a signature and of its owner.
HELD, KNOWN, SIG, OWN = 3_000_000, 200_000, 5, 6


def bands(largest: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, k) of each size band up to `largest`; k bounds the elements in which a set of
    the band and a similar one that is not smaller differ."""
    out, low = [], 1
    while low <= largest:
        high = low * den // num
        out.append((low, high, high * (den - num) // num))
        low = high + 1
    return out


@lru_cache(None)
def _table(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(bands(largest, num, den), np.int64)
    return found[:, 0], found[:, 2]


def need(k: int) -> int:
    """Signatures of a band that similar sets share at least."""
    return 1 + k // SPARE


@lru_cache(None)
def plan(k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) whose signatures cover the largest share of the domain, with no more of them than two of three
    parts for every other difference make."""
    most, found = max(LEAST, 3 * (k // 2 + need(k))), []
    for k2 in range(min(k, 4) + 1):
        n1 = k // (k2 + 1) + need(k)
        found += [((1 - k2 / n2) / n1, -k2, n1, n2) for n2 in range(k2 + 1, 26) if n1 * comb(n2, k2) <= most]
    _, k2, n1, n2 = max(found)
    return n1, n2, -k2


def per_element(num: int, den: int, size: int = 1_000) -> float:
    """Signatures for each element of a set."""
    lows, ks = _table(2 * size, num, den)
    band = int(np.searchsorted(lows, size, side="right")) - 1
    return sum(n1 * comb(n2, k2) for n1, n2, k2 in (plan(int(k)) for k in ks[max(band - 1, 0) : band + 1])) / size


def signatures(flat: np.ndarray, offsets: np.ndarray, band: int, k: int) -> np.ndarray:
    """PartEnum signatures of sorted sets, all of one band: one row a set."""
    sets = len(offsets) - 1
    if k == 0:  # only equal sets, which have collapsed before
        return np.zeros((sets, 0), np.uint64)
    n1, n2, k2 = plan(k)
    cells = n1 * n2
    at = ((flat >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    filled = np.bincount(np.repeat(np.arange(sets) * cells, np.diff(offsets)) + at, minlength=sets * cells)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    ends = np.cumsum(filled)
    own = (sums[ends] - sums[ends - filled]).reshape(-1, n2)
    whole = own.sum(axis=1, dtype=np.uint64)
    part = mix(np.arange(n1, dtype=np.uint64) + salt(band + 1))
    found = np.empty((sets * n1, comb(n2, k2)), np.uint64)
    for j, left_out in enumerate(combinations(range(n2), k2)):
        found[:, j] = mix((whole - own[:, list(left_out)].sum(axis=1, dtype=np.uint64)) ^ mix(np.tile(part, sets) + np.uint64(j)))
    return found.reshape(sets, -1)


def _pieces(batches):
    """Runs of rows of a few MB of text, which bounds what a task holds."""
    for batch in batches:
        yield from slices(batch)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all rows in one array, and their offsets."""
    words, offsets = split_words(batch.column("text"))
    body, at = shingles(hash_strings(words), offsets, width)
    sets = [np.unique(body[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def _digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two arrays of signed longs."""
    found = []
    for x in (mix(flat), mix(flat ^ np.uint64(0x5851F42D4C957F2D))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        found.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return found[0], found[1]


def _short(digest: np.ndarray) -> np.ndarray:
    """What signatures name their owner by: the last OWN bytes of a digest. Two sets of one name both become
    candidates."""
    return digest & np.int64((1 << 8 * OWN) - 1)


def set_digests(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc, n_shingles, d1, d2, need) of every document; equal digests mean equal sets."""

    def run(batches):
        for batch in _pieces(batches):
            flat, offsets = _sets(batch, width)
            n = np.diff(offsets)
            lows, ks = _table(2 * int(n.max(initial=1)), num, den)
            least = 1 + ks[np.maximum(np.searchsorted(lows, n, side="right") - 2, 0)] // SPARE
            columns = [batch.column("doc"), pa.array(n), *map(pa.array, _digests(flat, offsets)), pa.array(least, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "d1", "d2", "need"])

    return docs.mapInArrow(run, "doc long, n_shingles long, d1 long, d2 long, need long")


def _cut(values: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :size]


def _uncut(data: list[bytes], size: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view(np.uint64).ravel()


def signature_blobs(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Signatures packed by bucket of the signature: (bucket, sigs, owners), SIG and OWN bytes each. Copies that a
    task knows sign once."""

    def run(batches):
        known: set[int] = set()
        for batch in _pieces(batches):
            flat, offsets = _sets(batch, width)
            n, names = np.diff(offsets), _digests(flat, offsets)[0]
            fresh = np.zeros(len(n), bool)
            for i, name in enumerate(names.tolist()):
                if n[i] and name not in known:
                    known.add(name)
                    fresh[i] = True
            if len(known) > KNOWN:
                known.clear()
            if not fresh.any():
                continue
            lows, ks = _table(2 * int(n.max()), num, den)
            band = np.searchsorted(lows, n, side="right") - 1
            found, owners = [], []
            for b in np.unique(band[fresh]).tolist():
                mine = np.flatnonzero(fresh & (band == b))
                body = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in mine])
                ends = np.concatenate([[0], np.cumsum(n[mine])])
                for other in (b, b - 1):
                    if other >= 0:
                        own = signatures(body, ends, other, int(ks[other]))
                        found.append(own.ravel())
                        owners.append(np.repeat(names[mine], own.shape[1]))
            sig, owner = np.concatenate(found), np.concatenate(owners)
            if not len(sig):
                continue
            bucket = ((sig >> np.uint64(8 * SIG)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, owner, bucket = _cut(sig[order], SIG), _cut(_short(owner[order]), OWN), bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = list(zip(starts, np.append(starts[1:], len(bucket)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts], pa.int64()), pa.array([sig[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in cuts], pa.binary())],
                names=["bucket", "sigs", "owners"],
            )

    return docs.mapInArrow(run, "bucket long, sigs binary, owners binary")


def _tell(sig: np.ndarray, owner: np.ndarray, told: np.ndarray):
    """Rows to tell of the signatures with two owners, and the rows to keep: one a signature, told if its group was."""
    order = np.lexsort((owner, sig))
    sig, owner, told = sig[order], owner[order], told[order]
    start = np.ones(len(sig), bool)
    start[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(start)
    lows, highs = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
    shared = (lows != highs) | np.logical_or.reduceat(told, at)
    new = np.ones(len(sig), bool)
    new[1:] = start[1:] | (owner[1:] != owner[:-1])
    say = np.repeat(shared, np.diff(np.append(at, len(sig)))) & new & ~told
    return (sig[say], owner[say]), (sig[at], owner[at], shared)


def shared_signatures(blobs: DataFrame) -> DataFrame:
    """(sig, owner) of the signatures that at least two sets have, a few more than once; blobs of one bucket lie in
    one partition. A task keeps one row of each signature: a frequent one's rows are told as they come."""

    def run(batches):
        kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
        rows, held = [], 0

        def told():
            nonlocal kept, rows, held
            sig, owner = (np.concatenate([kept[i], *(r[i] for r in rows)]) for i in (0, 1))
            rows, held = [], 0
            if not len(sig):
                return
            (sig, owner), kept = _tell(sig, owner, np.concatenate([kept[2], np.zeros(len(sig) - len(kept[0]), bool)]))
            for i in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].view(np.int64)) for x in (sig, owner)], names=["sig", "owner"])

        for batch in batches:
            packed = batch.column("sigs").to_pylist()
            bucket = np.repeat(batch.column("bucket").to_numpy(zero_copy_only=False), [len(x) // SIG for x in packed])
            sig = _uncut(packed, SIG) | (bucket.astype(np.uint64) << np.uint64(8 * SIG))
            rows.append((sig, _uncut(batch.column("owners").to_pylist(), OWN)))
            held += len(sig)
            if held > max(HELD, len(kept[0])):
                yield from told()
        yield from told()

    return blobs.mapInArrow(run, "sig long, owner long")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y."""
    each = x if y is x else x + y
    code, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(s) for s in each])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    shared = ~new  # elements of one set alone meet nothing
    shared[:-1] |= ~new[1:]
    row, new = row[shared], new[shared]
    code = np.cumsum(new) - 1
    out = np.zeros((len(x), len(y)), np.float64)
    for low in range(0, int(new.sum()), COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        held = np.zeros((len(each), int(code[b - 1]) + 1 - low), np.float32)
        held[row[a:b], code[a:b] - low] = 1
        out += held[: len(x)] @ held[-len(y) :].T
    if y is x:
        np.fill_diagonal(out, [len(s) for s in x])
    return out


def _links(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    m, n = (np.array([len(s) for s in side], np.float64) for side in (x, y))
    common = _common(x, y)
    return den * common >= num * (m[:, None] + n[None, :] - common)


def _forest(x: list[np.ndarray], y: list[np.ndarray] | None, names: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set of x and y (all of x, if y is None), the place of one that it is connected with; sets of one
    name are connected as they are."""
    link, m = _links(x, x if y is None else y, num, den), len(names)
    rows, columns = np.nonzero(link)
    if y is not None:
        columns = columns + len(x)
    coded = np.unique(names, return_inverse=True)[1]
    label = np.arange(m)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[columns])
        np.minimum.at(new, columns, label[rows])
        least = np.full(int(coded.max()) + 1, m)
        np.minimum.at(least, coded, new)
        new = np.minimum(new, least[coded])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _by_cell(batches, key: list[str], values: list[str], what: str = "elements"):
    """(key, rows) of every cell; rows have the values, and elements or a sketch. Batches come sorted by cell."""
    at, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
        own = zip(*(batch.column(c).to_pylist() for c in values), batch.column(what), strict=True)
        for cell, (*value, held) in zip(keys, own, strict=True):
            if cell != at:
                if rows:
                    yield at, rows
                at, rows = cell, []
            rows.append((*value, held.as_py() if what == "sketch" else held.values.to_numpy().copy()))
    if rows:
        yield at, rows


def sketch(elements: np.ndarray) -> bytes:
    """Whether the number of elements that fall to each bit is odd; at least two bits an element, a power of two."""
    bits = 64 << max(0, int(2 * len(elements) - 1).bit_length() - 6)
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(x: list[tuple[bytes, int]], y: list[tuple[bytes, int]], num: int, den: int) -> np.ndarray:
    """Pairs of (sketch, size) that may link: two sets differ in as many elements as their sketches do in bits, at
    least. A longer sketch folds to the length of a shorter one."""
    size, width = np.array([n for _, n in [*x, *y]], np.float64), min(len(s) for s, _ in [*x, *y])
    bits = []
    for data, _ in [*x, *y]:
        own = np.frombuffer(data, np.uint64)
        while len(own) > width // 8:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        bits.append(own)
    bits, out = np.stack(bits), np.zeros((len(x), len(y)), bool)
    for i in range(len(x)):
        apart = np.bitwise_count(bits[len(x) :] ^ bits[i]).sum(axis=1)
        other = size[len(x) :]
        out[i] = (apart * (den + num) <= (size[i] + other) * (den - num)) & (den * np.minimum(size[i], other) >= num * np.maximum(size[i], other))
    return out


def with_partners(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of cells (cell, lo, hi, side, node, component) that may link with one of another component there."""
    key = ["cell", "lo", "hi"]
    rows = _dealt(cells.select(*key, "side", "node", "component").join(sets.select("node", "n", "sketch"), "node"), key)

    def run(batches):
        for cell, own in _by_cell(batches, key, ["side", "node", "component", "n"], "sketch"):
            sides = [[r for r in own if r[0] == 0], [r for r in own if r[0] == 1]] if cell[1] != cell[2] else [own, own]
            if not all(sides):
                continue
            component = [np.array([r[2] for r in side], np.int64) for side in sides]
            near = may_link(*([(r[4], r[3]) for r in side] for side in sides), num, den) & (component[0][:, None] != component[1][None, :])
            kept = [r for i, side in enumerate(sides[: 2 - (cell[1] == cell[2])]) for r, any_near in zip(side, near.any(axis=1 - i), strict=True) if any_near]
            columns = [*([value] * len(kept) for value in cell), *([r[i] for r in kept] for i in range(3))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*key, "side", "node", "component"])

    return rows.mapInArrow(run, "cell long, lo int, hi int, side int, node long, component long")


def _dealt(cells: DataFrame, key: list[str]) -> DataFrame:
    return cells.repartition(*key).sortWithinPartitions(*key)


def forests(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between components, of spanning forests of the links of each cell; cells: (cell, lo, hi, side,
    node, component). In a cell whose lo and hi differ, sets of different sides are compared, else all sets."""
    key = ["cell", "lo", "hi"]
    rows = _dealt(with_partners(cells, sets, num, den).join(sets.select("node", "elements"), "node"), key)

    def run(batches):
        for cell, own in _by_cell(batches, key, ["side", "component"]):
            sides = [[r for r in own if r[0] == 0], [r for r in own if r[0] == 1]] if cell[1] != cell[2] else [own]
            if not all(sides):
                continue
            own = [r for side in sides for r in side]
            components = np.array([r[1] for r in own], np.int64)
            label = _forest([r[2] for r in sides[0]], [r[2] for r in sides[1]] if len(sides) > 1 else None, components, num, den)
            edges = np.unique(np.stack([components, components[label]], 1), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _tiles(n: F.Column, elements: F.Column) -> F.Column:
    return F.ceil(F.greatest(n / TILE, elements / TILE_ELEMENTS, F.lit(1))).cast("int")


def tiled(groups: DataFrame, key: str) -> DataFrame:
    """Cells (cell, lo, hi, side) of groups (key, node, n, ...): a group is cut into tiles, and each pair of tiles
    is a cell."""
    tiles = groups.groupBy(key).agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    each = groups.join(tiles, key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.withColumns({"cell": F.col(key), "lo": F.least("tile", "other"), "hi": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
    return each.drop("tiles", "tile", "other")


def balls(pairs: DataFrame) -> DataFrame:
    """Cells of leaders and those who share a group with them; pairs: (lead, node, tiles, component). The leader is
    in each cell of its ball."""
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    each = pairs.withColumn("lo", F.explode(F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(tile))))
    return each.select(F.col("lead").alias("cell"), "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"), "node", "component")


def led(live: DataFrame) -> DataFrame:
    """live with the leader of each group (the member of the most groups) and the tiles of the leader's ball."""
    weight = live.groupBy("node").agg(F.sum("many").alias("weight"))
    lead = live.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", F.xxhash64("node").alias("tie"), "node"))["node"].alias("lead"))
    met = live.join(lead, "sig")
    sizes = met.select("lead", "node", "n").distinct().groupBy("lead").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    return met.join(sizes, "lead")


def enough(live: DataFrame) -> DataFrame:
    """Of groups (sig, node, need, many, ...), each standing for `many`, those of members that have as many as links need."""
    able = live.groupBy("node").agg(F.sum("many").alias("have"), F.max("need").alias("need")).where("have >= need").select("node")
    return live.join(able, "node", "left_semi")


def once(live: DataFrame) -> DataFrame:
    """Of groups (sig, node, need) with the same members one stays, and `many` counts them; groups of one go."""
    members = live.groupBy("sig").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).where("size > 1")
    kept = members.groupBy("size", "h1", "h2").agg(F.min("sig").alias("sig"), F.count("*").alias("many")).select("sig", "many")
    return live.select("sig", "node", "need").join(kept, "sig")


def settle(live: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """Components (node, component) of the links among members of the same groups (sig, node, need, many); sets:
    (node, n, elements). None if there are no links."""
    sizes = sets.select("node", "n")
    live = scratch.save(live.join(sizes, "node").withColumn("component", F.col("node")), "groups-0")
    merges = []

    def merged(edges: DataFrame, label: str) -> bool:
        edges = scratch.save(edges, label)
        found = not edges.isEmpty()
        if found:
            merges.append(connected_components(edges, scratch, f"{label}-cc"))
        scratch.drop(label)
        return found

    # what follows goes by pairs of a leader and a set, not by each group that they share; `many` counts these
    ball = led(live).groupBy("lead", "node", "n", "tiles", "component").agg(F.sum("many").alias("many"), F.max("need").alias("need"))
    ball = scratch.save(ball, "ball")
    scratch.drop("groups-0")
    found = merged(forests(balls(ball), sets, num, den), "balls")
    # of a ball in one cell all pairs have been compared; of others, sets of one component are settled, and only those
    # that share enough groups of the rest may have a link that has not been seen
    rest = ball.where("tiles > 1 AND node <> lead").withColumnRenamed("lead", "sig").drop("tiles")
    rest = scratch.save(renamed(rest, merges[-1]) if found else rest, "rest-0")
    rest = scratch.save(enough(unsettled(rest)), "rest-1")
    rest = scratch.save(enough(unsettled(rest)), "rest-2")
    scratch.drop("ball", "rest-0", "rest-1")
    if not rest.isEmpty():
        merged(forests(tiled(rest, "sig"), sets, num, den), "rest")
    if not merges:
        return None
    nodes = reduce(DataFrame.unionByName, [m.select("node") for m in merges]).distinct().withColumn("component", F.col("node"))
    return scratch.save(reduce(renamed, merges, nodes), "components")


def count_links(components: DataFrame, sets: DataFrame, weights: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n_links): the documents of the sets that link with the node's set. components: (node, component),
    sets: (node, n, elements), weights: (node, weight) with the documents of each set."""
    each = sets.select("node", "n").join(components, "node").join(weights, "node")
    key = ["cell", "lo", "hi"]
    rows = _dealt(tiled(each, "component").select(*key, "side", "node", "weight").join(sets.select("node", "elements"), "node"), key)

    def run(batches):
        for cell, own in _by_cell(batches, key, ["side", "node", "weight"]):
            sides = [[r for r in own if r[0] == 0], [r for r in own if r[0] == 1]] if cell[1] != cell[2] else [own, own]
            if not all(sides):
                continue
            x = [r[3] for r in sides[0]]
            link = _links(x, x if sides[0] is sides[1] else [r[3] for r in sides[1]], num, den)
            nodes, weight = ([np.array([r[i] for r in side], np.int64) for side in sides] for i in (1, 2))
            if cell[1] == cell[2]:
                np.fill_diagonal(link, False)
            counts = [link @ weight[1], link.T @ weight[0]]
            for side in range(1 if cell[1] == cell[2] else 2):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[side]), pa.array(counts[side])], names=["node", "n_links"])

    return rows.mapInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, counted: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable by links, itself included) and, if
    `counted`, n_links, the number of other documents at or above the similarity, copies among them."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")

    rows = scratch.save(set_digests(docs, width, num, den), "digests")
    first = rows.groupBy("doc").agg(F.min(F.struct("n_shingles", "d1", "d2", "need")).alias("s")).select("doc", "s.*")
    sets = first.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc").alias("rep"))
    member = scratch.save(first.join(sets, ["n_shingles", "d1", "d2"], "left").select("doc", "n_shingles", "d1", "d2", "need", F.coalesce("rep", "doc").alias("rep")), "members")
    scratch.drop("digests")
    reps = member.where("doc = rep AND n_shingles > 0")

    elements = reps.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(elements * per_element(num, den) / HELD) + 1)
    shared = scratch.save(shared_signatures(signature_blobs(docs, width, num, den, buckets).repartition(buckets, "bucket")), "shared")
    named = reps.select(F.expr(f"d1 & {(1 << 8 * OWN) - 1}L").alias("owner"), F.col("rep").alias("node"), "need")
    groups = shared.join(named, "owner").select("sig", "node", "need").distinct().withColumn("many", F.lit(1).cast("long"))
    live = scratch.save(enough(groups), "able")
    live = scratch.save(once(live), "once")
    live = scratch.save(enough(live), "live")
    scratch.drop("shared", "able", "once")
    candidates = member.select("doc", "d1", "d2").join(live.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi")

    def sets_of(batches):
        for batch in _pieces(batches):
            flat, offsets = _sets(batch, width)
            d1, d2 = _digests(flat, offsets)
            own = (d1 == batch.column("d1").to_numpy(zero_copy_only=False)) & (d2 == batch.column("d2").to_numpy(zero_copy_only=False))
            sketches = pa.array([sketch(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            columns = [batch.column("doc"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))), sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "elements", "sketch"]).filter(pa.array(own))

    found = scratch.save(docs.join(candidates, "doc").mapInArrow(sets_of, "node long, n long, elements array<long>, sketch binary").dropDuplicates(["node"]), "sets")

    components = settle(live, found, num, den, scratch)
    if not counted:
        groups = member.select(F.col("doc").alias(id_col), "n_shingles", "rep")
        if components is None:
            return groups.withColumnRenamed("rep", "component_id")
        return groups.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(id_col, "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    # a set's documents link with one another, as equal sets do
    weights = member.where("n_shingles > 0").groupBy("rep").agg(F.count("*").alias("weight"))
    member = member.join(weights, "rep", "left")
    n_links = F.coalesce(F.col("weight") - 1, F.lit(0).cast("long"))
    if components is None:
        return member.select(F.col("doc").alias(id_col), "n_shingles", F.col("rep").alias("component_id"), n_links.alias("n_links"))
    degree = count_links(components, found, weights.withColumnRenamed("rep", "node"), num, den)
    return (
        member.join(components.join(degree, "node", "left").withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"), (n_links + F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))
    )
