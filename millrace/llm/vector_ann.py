"""Approximate nearest neighbours by inner product: inverted lists, scanned dimension block by dimension block.

Centroids are fitted on a bounded sample, every vector goes to the list of its nearest centroid, and a query probes
the lists whose centroids have the largest inner products with it. Vectors are turned by one random rotation and lie
in column blocks. In a probed list the first DIMS rotated dimensions are taken for all pairs; then, block by block, a
hypothesis test decides for each pair that is left whether it can still enter the query's list: a random rotation
spreads a distance evenly, so from d of D dimensions the whole is D / d times the part, up to a factor of
1 + EPSILON / sqrt(d) that is exceeded for few in a thousand. Distance and inner product are tied by the norms. What
passes all tests is scored on the original vectors, in doubles.

The nearest list is probed first, and its k-th score is where the other lists start from. How many lists are probed
is measured, not set: a bounded sample of queries is answered by brute force over all vectors, and the least number
that finds TARGET of their neighbours is taken, so recall holds on data without clusters, too (there the lists
probed are many).

Lists are no groups of their own: blocks of a list and blocks of the queries that probe it are dealt into tiles of
bounded bytes. Of equal vectors only the k + 1 least ids can be among anybody's k nearest; the others leave the
index, so a vector that a third of all rows share is k + 1 rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do rows
with a null id. Vectors of different lengths don't meet; a length that the sample doesn't have is one list. Rows that
repeat an id are separate candidates; as a query such an id has the least of its vectors, and none of its own rows is
a candidate. Fewer candidates found than k give shorter lists; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.textops import held
from millrace.llm.vector_topk import usable

DIMS, EPSILON, TARGET = 16, 2.1, 0.95
#: Bounds of the sample that centroids are fitted on, of lists, and of the queries that recall is measured by.
SAMPLE, SAMPLE_BYTES, PER_LIST, MEASURED = 32_768, 64 << 20, 32, 256
GATHER_BYTES, SLOT_BYTES, QUERY_BYTES, QUERIES, ROWS = 16 << 20, 64 << 20, 16 << 20, 256, 1_024
PACKED = "dim int, list int, seq long, n int, ids binary, extra binary, rotated binary, vectors binary"
LISTS = "query_id long, vec_id long, score double"


def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    return held(("rotation", dim), lambda: np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0])


def fitted(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of the sample by Lloyd's method."""
    centroids = sample[np.random.default_rng(0).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centroids)
        count = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        centroids[full] = np.add.reduceat(sample[order], starts[full]) / count[full, None]
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = np.square(centroids).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - vectors[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(vectors), 4096)]])


def probed(vectors: np.ndarray, centroids: np.ndarray, many: int) -> np.ndarray:
    """The lists of each query, most promising first."""
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :many]


def _of(books: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return books.get(dim, np.zeros((1, dim)))


def _pack(vectors: DataFrame, lists_of) -> DataFrame:
    """Rows (vec_id, extra, embedding) in blocks of one length and list; lists_of(dim, vectors) gives the lists of
    each vector, a column for each."""

    def blocks(gathered: list[pa.RecordBatch], seq: int):
        part = TaskContext.get().partitionId()
        ids, extra = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in gathered]) for c in ("vec_id", "extra"))
        lists = pa.chunked_array([b.column("embedding") for b in gathered]).combine_chunks()
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            of_dim = np.flatnonzero(sizes == dim)
            own = flat[starts[of_dim][:, None] + np.arange(dim)]
            turned = own @ rotation(dim)
            chosen = lists_of(dim, own)
            row, key = np.repeat(np.arange(len(own)), chosen.shape[1]), chosen.ravel()
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, ROWS):
                    rows = row[at : min(hi, at + ROWS)]
                    took = of_dim[rows]
                    values = [dim, int(key[lo]), (part << 32) + seq, len(rows), ids[took].astype("<i8").tobytes(), extra[took].astype("<f8").tobytes(), turned[rows].T.astype("<f8").tobytes(), own[rows].astype("<f8").tobytes()]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])
                    seq += 1

    def run(batches):
        gathered, size, seq = [], 0, 0
        for batch in batches:
            gathered.append(batch)
            size += batch.nbytes
            if size >= GATHER_BYTES:
                for block in blocks(gathered, seq):
                    seq += 1
                    yield block
                gathered, size = [], 0
        if gathered:
            yield from blocks(gathered, seq)

    return vectors.select("vec_id", "extra", "embedding").mapInArrow(run, PACKED)


class Block:
    def __init__(self, row):
        self.ids, self.extra = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.extra, "<f8")
        self.columns = np.frombuffer(row.rotated, "<f8").reshape(row.dim, row.n)
        self.vectors = np.frombuffer(row.vectors, "<f8").reshape(row.n, row.dim)
        self.squares = np.square(self.vectors).sum(axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal sums."""
    return np.concatenate([np.zeros(0), *[(a[i : i + 32_768] * b[i : i + 32_768]).sum(axis=1) for i in range(0, len(a), 32_768)]])


class Search:
    """The k nearest of each query of a block, among those that reach the query's floor."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k, self.floor, self.tested, self.scored = queries, k, queries.extra.copy(), 0, 0
        self.top = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def passes(self, part: np.ndarray, d: int, squares: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether the part of the distance that d dimensions have is no proof, at the test's level, of a score below the floor."""
        whole = len(self.q.columns)
        return ~(whole / d * part > (1 + EPSILON / np.sqrt(d)) ** 2 * (squares - 2 * floor))

    def scan(self, x: Block) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            self._scan(x)

    def _scan(self, x: Block) -> None:
        q, dim, d = self.q, len(self.q.columns), min(DIMS, len(self.q.columns))
        part = np.square(q.columns[:d]).sum(axis=0)[:, None] + np.square(x.columns[:d]).sum(axis=0)[None, :] - 2 * (q.columns[:d].T @ x.columns[:d])
        if np.isneginf(self.floor).any():
            # a floor to start from: the k nearest by their first dimensions
            seeds = np.argpartition(part, min(self.k, part.shape[1] - 1), axis=1)[:, : self.k + 1]
            qi, ci = np.repeat(np.arange(len(q.ids)), seeds.shape[1]), seeds.ravel()
            scores = np.where(q.ids[qi] == x.ids[ci], -np.inf, exact(q.vectors[qi], x.vectors[ci])).reshape(seeds.shape)
            if seeds.shape[1] >= self.k:
                self.floor = np.fmax(self.floor, -np.sort(-scores, axis=1)[:, self.k - 1])
        alive = self.passes(part, d, q.squares[:, None] + x.squares[None, :], self.floor[:, None]) if d < dim else np.ones(part.shape, bool)
        qi, ci = np.nonzero(alive & (q.ids[:, None] != x.ids[None, :]))
        part = part[qi, ci]
        self.tested += alive.size
        for lo in range(d, dim - DIMS, DIMS):
            hi = lo + DIMS
            part = part + np.square(q.columns[lo:hi, qi] - x.columns[lo:hi, ci]).sum(axis=0)
            kept = self.passes(part, hi, q.squares[qi] + x.squares[ci], self.floor[qi])
            qi, ci, part = qi[kept], ci[kept], part[kept]
        self.scored += len(qi)
        scores = exact(q.vectors[qi], x.vectors[ci])
        kept = ~(scores < self.floor[qi])
        qi, ci, scores = qi[kept], ci[kept], scores[kept]
        copies = x.extra[ci].astype(np.int64)
        self._merge(np.repeat(qi, copies), np.repeat(scores, copies), np.repeat(x.ids[ci], copies))

    def _merge(self, qi: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        qi, scores, ids = (np.concatenate(x) for x in zip(self.top, (qi, scores, ids), strict=True))
        order = np.lexsort((ids, -scores, qi))
        qi, scores, ids = qi[order], scores[order], ids[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        kth = rank == self.k - 1
        self.floor[qi[kth]] = np.fmax(self.floor[qi[kth]], scores[kth])
        self.top = tuple(x[rank < self.k] for x in (qi, scores, ids))

    def rows(self) -> pd.DataFrame:
        qi, scores, ids = self.top
        return pd.DataFrame({"query_id": self.q.ids[qi], "vec_id": ids, "score": scores})


def _tiles(asked: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the nearest that each tile of queries and vectors of a list has."""
    weight = lambda rows, most: F.ceil(F.sum(F.col("n").cast("long") * F.col("dim") * 16) / most).cast("int")
    slots, turns = (df.groupBy("dim", "list").agg(weight(df, most).alias(c)) for df, most, c in ((packed, SLOT_BYTES, "slots"), (asked, QUERY_BYTES, "turns")))
    shape = slots.join(turns, ["dim", "list"])
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("seq"), F.col(c)).cast("int")
    left = asked.join(shape, ["dim", "list"]).withColumn("turn", dealt("turns")).withColumn("slot", each("slots"))
    right = packed.join(shape, ["dim", "list"]).withColumn("slot", dealt("slots")).withColumn("turn", each("turns"))
    keys = ["dim", "list", "slot", "turn"]

    def run(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        blocks = [Block(row) for row in others.sort_values("seq").itertuples()] if len(queries) else []
        for row in queries.sort_values("seq").itertuples() if blocks else ():
            search = Search(Block(row), k)
            for block in blocks:
                search.scan(block)
            found.append(search.rows())
        return pd.concat(found, ignore_index=True)

    return left.select(*keys, *[c for c in asked.columns if c not in keys]).groupBy(*keys).cogroup(right.select(*keys, *[c for c in packed.columns if c not in keys]).groupBy(*keys)).applyInPandas(run, LISTS)


def _best(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _drawn(vectors: DataFrame, share: float, most: int, seed: int) -> DataFrame:
    """About share of the vectors, at most `most`, by a hash of the row."""
    rows = vectors.where((F.pmod(F.xxhash64("vec_id", F.element_at("embedding", 1), F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))))
    return rows.select("vec_id", "embedding").limit(most)


def _measured(packed: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> list:
    """The k nearest of a few queries by brute force, with the lists where they are."""

    def run(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                if row.dim not in queries:
                    continue
                ids, vectors = queries[row.dim]
                block = Block(row)
                scores = np.where(ids[:, None] == block.ids[None, :], -np.inf, vectors @ block.vectors.T)
                best = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k]
                for i, places in enumerate(best):
                    kept = found.setdefault((row.dim, i), [])
                    kept += [(-float(scores[i, j]), int(block.ids[j]), row.list) for j in places if scores[i, j] > -np.inf]
                    kept.sort()
                    del kept[k:]
        rows = [(dim, i, -s, vec_id, at) for (dim, i), kept in found.items() for s, vec_id, at in kept]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["dim", "query", "score", "vec_id", "list"])

    rows = packed.mapInArrow(run, "dim int, query int, score double, vec_id long, list int")
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "vec_id")
    # at most 4 * MEASURED * k rows
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("dim", "query", "list").collect()


def probes(found: list, queries: dict[int, tuple[np.ndarray, np.ndarray]], books: dict[int, np.ndarray], target: float) -> dict[int, int]:
    """The least number of lists that holds `target` of the neighbours found by brute force, for each length."""
    many = {}
    for dim, (_, vectors) in queries.items():
        order = probed(vectors, _of(books, dim), len(_of(books, dim)))
        place = np.argsort(order, axis=1)
        own = np.sort(np.array([place[r.query, r.list] for r in found if r.dim == dim], np.int64))
        many[dim] = int(own[min(len(own) - 1, int(np.ceil(target * len(own))) - 1)]) + 1 if len(own) else len(place[0])
    return many


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, target: float = TARGET, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found; both frames have (vec_id, embedding)."""
    scratch = scratch or Scratch(queries.sparkSession, "ann")
    rows = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0))
    every = rows(candidates).groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("double").alias("extra"))
    least = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    every = scratch.save(every.withColumn("place", least).where(F.col("place") <= k + 1).drop("place"), "vectors")
    asked = scratch.save(rows(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")

    n, held_bytes = every.agg(F.count("*"), F.sum(8 * F.size("embedding").cast("long"))).first()
    most = max(1, min(SAMPLE, int(SAMPLE_BYTES * n / (held_bytes or 1))))
    sample = _by_dim(_drawn(every, most / max(n, 1), most, 1).toArrow())
    total = sum(len(v) for _, v in sample.values())
    books = {}
    for dim, (_, own) in sample.items():
        lists = max(1, min(round((n * len(own) / total) ** 0.5), len(own) // PER_LIST))
        books[dim] = fitted(own, lists) if lists > 1 else np.zeros((1, dim))
    packed = scratch.save(_pack(every, lambda dim, own: nearest(own, _of(books, dim))[:, None]), "packed")

    few = _by_dim(_drawn(asked, MEASURED / max(asked.count(), 1), 4 * MEASURED, 2).toArrow())
    many = probes(_measured(packed, few, k), few, books, target)
    chosen = lambda dim, own, lo, hi: probed(own, _of(books, dim), len(_of(books, dim)))[:, lo:hi]
    open_floor = asked.withColumn("extra", F.lit(float("-inf")))
    first = scratch.save(_pack(open_floor, lambda dim, own: chosen(dim, own, 0, 1)), "first")
    near = scratch.save(_best(_tiles(first, packed, k), k).select("query_id", "vec_id", "score"), "near")
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("extra"))
    raised = asked.join(floors, "vec_id", "left").na.fill(float("-inf"), ["extra"])
    others = scratch.save(_pack(raised, lambda dim, own: chosen(dim, own, 1, many.get(dim))), "others")
    return _best(near.unionByName(_tiles(others, packed, k)), k).select("query_id", "rank", "vec_id", "score")


def _by_dim(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of each length."""
    found: dict[int, tuple[list, list]] = {}
    for vec_id, vector in zip(table["vec_id"].to_pylist(), table["embedding"], strict=True):
        own = found.setdefault(len(vector), ([], []))
        own[0].append(vec_id)
        own[1].append(vector.values.to_numpy(zero_copy_only=False))
    return {dim: (np.array(ids), np.array(vectors)) for dim, (ids, vectors) in found.items()}
