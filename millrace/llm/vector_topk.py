"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions.

Vectors are packed into blocks in vertical layout, one row of memory a dimension. For a block of queries and a
block of candidates the inner products of the first DIMS dimensions are taken for all pairs; from then on each
query keeps only the candidates that can still reach its list: what the remaining dimensions can add is at most
the product of both remaining masses (Cauchy-Schwarz), and what falls short of the k-th best score is compacted
away before the next dimensions are read. The k best after the first dimensions are scored in full first, which
gives a bound to start from; it rises from block to block.

Queries and candidates meet in tiles: query blocks of at most QUERY_BYTES and candidate slots of about SLOT_BYTES,
joined by a shuffle on (query block, slot). A candidate is sent once for each query block, so blocks are as large
as a task may hold; inside a tile, QUERIES of them at a time are compared with a candidate block. Lists of k per
query and tile are merged by a window. Nothing is broadcast or collected.

Components become floor(scale * x), so scores are exact integers: sums below 2**53 are taken in doubles, others
in whole numbers of any length. Scores beyond a long are held at its limits, and tie there.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; nor do rows
with a null id. Vectors of different lengths don't meet. Rows that repeat an id are separate candidates; as a
query such an id has the least of its vectors, and none of its own rows is a candidate. Fewer than k candidates
give shorter lists; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

DIMS, QUERIES, EXACT = 16, 512, float(2**53)
BLOCK_BYTES, QUERY_BYTES, SLOT_BYTES = 4 << 20, 32 << 20, 64 << 20
PACKED = "slot long, seq long, dim int, n int, ids binary, whole boolean, rows binary"
LISTS = "query_id long, vec_id long, score long"


def usable(vector: str) -> Column:
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floored(values: np.ndarray, scale: int) -> tuple[np.ndarray, bool]:
    """floor(scale * x), and whether its entries fit doubles as whole numbers."""
    found = np.floor(values.astype(np.float64) * scale)
    if np.isfinite(found).all() and np.abs(found).max(initial=0) < EXACT:
        return found, True
    from fractions import Fraction
    from math import floor

    return np.array([floor(Fraction(float(x)) * scale) for x in values.ravel()], object).reshape(values.shape), False


def _pack(vectors: DataFrame, slots: int, most_bytes: int, scale: int) -> DataFrame:
    """Blocks of vectors of one length, of most_bytes or one vector at most, dealt over `slots` slots."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
            lists = batch.column("embedding").cast(pa.list_(pa.float64()))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                of_dim, most = np.flatnonzero(sizes == dim), max(1, most_bytes // (8 * int(dim)))
                for i in range(0, len(of_dim), most):
                    at = of_dim[i : i + most]
                    rows, whole = floored(flat[starts[at][:, None] + np.arange(dim)], scale)
                    columns = np.ascontiguousarray(rows.T)
                    data = columns.astype("<f8").tobytes() if whole else "\n".join(map(str, columns.ravel())).encode()
                    slot = hash((part, seq)) % slots
                    row = [slot, part * (1 << 32) + seq, int(dim), len(at), ids[at].tobytes(), whole, data]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])
                    seq += 1

    return vectors.select("vec_id", "embedding").mapInArrow(run, PACKED)


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    shape = (row.dim, row.n)
    if row.whole:
        columns = np.frombuffer(row.rows, "<f8").reshape(shape)
    else:
        columns = np.array([int(x) for x in row.rows.decode().split("\n")], object).reshape(shape)
    return np.frombuffer(row.ids, "<i8"), columns


def masses(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Length of each vector's part from each cut on."""
    squares = np.square(columns.astype(np.float64))
    return np.sqrt(np.array([squares[c:].sum(axis=0) for c in cuts]))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Tile:
    """Running lists of the k best of each query of a block."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.columns, self.k = ids, columns, k
        self.cuts = [*range(0, len(columns), DIMS), len(columns)]
        self.mass = masses(columns, self.cuts)
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, columns.dtype), np.zeros(0, np.int64)) for _ in ids]

    def search(self, ids: np.ndarray, columns: np.ndarray) -> None:
        mass = masses(columns, self.cuts)
        if self.columns.dtype == object or columns.dtype == object or (self.mass[0].max(initial=0) * mass[0].max(initial=0)) * 1.001 >= EXACT:
            return self._search_whole(ids, columns)
        first = self.columns[: self.cuts[1]].T @ columns[: self.cuts[1]]
        for q, own in enumerate(self.ids):
            partial = first[q]
            upper = partial + self.mass[1, q] * mass[1] * (1 + 1e-9)
            scores, found = self.top[q]
            seeds = np.argpartition(-upper, min(self.k, len(upper) - 1))[: self.k + 1]
            seeds = seeds[ids[seeds] != own]
            known = np.concatenate([scores, self.columns[:, q] @ columns[:, seeds]])
            bound = np.sort(known)[-self.k] if len(known) >= self.k else -np.inf
            alive = np.flatnonzero(upper >= bound - 0.5)
            partial = partial[alive]
            for b in range(1, len(self.cuts) - 1):
                lo, hi = self.cuts[b : b + 2]
                partial = partial + self.columns[lo:hi, q] @ columns[lo:hi, alive]
                kept = partial + self.mass[b + 1, q] * mass[b + 1, alive] * (1 + 1e-9) >= bound - 0.5
                alive, partial = alive[kept], partial[kept]
            self._merge(q, ids[alive], partial)

    def _search_whole(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """Numbers too large for doubles: whole numbers of any length."""
        whole = [np.array([int(x) for x in c.ravel()], object).reshape(c.shape) for c in (self.columns, columns)]
        scores = np.clip(whole[0].T.dot(whole[1]), -(2**63), 2**63 - 1)
        for q in range(len(self.ids)):
            self._merge(q, ids, scores[q])

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[q]
        scores, ids = np.concatenate([self.top[q][0], scores[other]]), np.concatenate([self.top[q][1], ids[other]])
        best = _best(scores, ids, self.k) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        self.top[q] = scores[best], ids[best]

    def rows(self) -> pd.DataFrame:
        found = [(int(own), int(i), int(s)) for own, (scores, ids) in zip(self.ids, self.top, strict=True) for s, i in zip(scores, ids, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates; both frames have (vec_id, embedding)."""
    scratch = scratch or Scratch(queries.sparkSession, "topk")
    queries, candidates = (x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding")) for x in (queries, candidates))
    held = lambda vectors: 8 * (vectors.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0)
    slots = max(1, -(-held(candidates) // SLOT_BYTES))
    # one vector for each query id
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.save(_pack(asked.repartition(max(1, -(-held(asked) // QUERY_BYTES)), "vec_id"), 1, QUERY_BYTES, scale), "queries")
    packed = scratch.save(_pack(candidates, slots, BLOCK_BYTES, scale), "candidates")

    blocks = asked.select("dim", F.col("seq").alias("block"))
    # the list of query blocks is 24 bytes for each
    wanted = packed.join(blocks, "dim").select("block", *packed.columns)
    left = asked.withColumn("block", F.col("seq")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).select("block", *asked.columns)

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in LISTS.split(", ")})
        ids, columns = _unpack(own.iloc[0])
        tiles = [Tile(ids[i : i + QUERIES], columns[:, i : i + QUERIES], k) for i in range(0, len(ids), QUERIES)]
        for row in others.sort_values("seq").itertuples():
            block = _unpack(row)
            for tile in tiles:
                tile.search(*block)
        return pd.concat([tile.rows() for tile in tiles], ignore_index=True)

    lists = left.groupBy("block", "slot").cogroup(wanted.groupBy("block", "slot")).applyInPandas(run, LISTS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
