"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are character and word statistics of the line and of its neighbours;
the chain couples neighbouring labels. Training maximises the likelihood of labelled documents, each line
taking its document's label. A document's score is the mean of its lines' forward-backward marginals, weighted
by their bytes. Features see the text alone.

Training uses a bounded sample: at most about SAMPLE labelled documents, chosen by a hash of the id. Scoring
covers every document in one pass without a shuffle.

Defined results: a null or empty text is one empty line and gets that line's marginal. Labels that are null, or
contradict each other for one id, are left out of training. Without labels of both kinds every score is 0.5.
A null id gives held_out false (it has no labels). Repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import small_batches
from millrace.llm.textops import hash_strings, slices, split_words, whole

SAMPLE, MOST_LINES = 6_000, 500
STEPS, RATE, DECAY = 200, 0.1, 1e-4
OWN = 20  # features of a line, besides those of its neighbours


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x OWN features, bytes of each line, line offsets of each text)."""
    texts = whole(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, at)) + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    first = np.zeros(offsets[-1], bool)
    first[offsets[:-1]] = True
    last = np.roll(first, -1)
    starts, ends = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    starts[first], starts[~first] = at[:-1], breaks + 1
    ends[last], ends[~last] = at[1:], breaks

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    table = np.zeros(256, np.uint8)  # kinds of byte
    for kind, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:?'\"-()", "!", "|", "#$%&*+/<=>@[\\]^_`{}~"], 1):
        table[np.frombuffer(chars.encode(), np.uint8)] = kind
    kinds = table[data]
    space = kinds == 4
    opens = ~space & np.concatenate([[True], space[:-1]])[: len(space)]
    if len(at) > 1 and len(data):  # a text begins a word even when the one before it ends in one
        inner = at[:-1][at[:-1] < len(data)]
        opens[inner] = ~space[inner]
    closes = np.concatenate([opens[1:] | space[1:], [True]])[: len(space)] & ~space
    size = (ends - starts).astype(np.float64)
    n = np.maximum(size, 1)
    words = total(opens)
    w = np.maximum(words, 1)
    h = hash_strings(split_words(texts)[0])
    line_of = np.repeat(np.arange(len(words)), words.astype(np.int64))
    again = np.zeros(len(h), bool)
    for back in (1, 2, 3):
        again[back:] |= (h[back:] == h[:-back]) & (line_of[back:] == line_of[:-back])
    by_kind = [total(kinds == k) for k in range(9)]
    letters = np.maximum(by_kind[1] + by_kind[2], 1)
    edge = lambda where, kind: np.where(size > 0, kinds[np.clip(where, 0, max(len(kinds) - 1, 0))] == kind, False) if len(kinds) else np.zeros(len(size))
    out = np.column_stack(
        [
            np.ones(len(n)),
            np.log1p(size) / 5,
            np.log1p(words) / 5,
            *[by_kind[k] / n for k in (0, 1, 3, 4, 5, 6, 7, 8)],
            by_kind[2] / letters,
            np.bincount(line_of[again], minlength=len(words)) / w if len(h) else np.zeros(len(n)),
            np.minimum(size / w, 40) / 10,
            total(closes & (kinds >= 6)) / w,
            total(closes & (kinds == 5)) / w,
            total(opens & (kinds == 2)) / w,
            edge(starts, 2),
            edge(ends - 1, 5),
            size == 0,
        ]
    )
    return out, size, offsets


def with_neighbours(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and of the line after; zeros at the ends of a text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.hstack([x, before, after])


def _columns(offsets: np.ndarray):
    """Lines by their place in the text, longest texts first: [(lines of place 0), (lines of place 1), ...]."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    places = np.arange(sizes[0] if len(sizes) else 0)
    active = np.searchsorted(-sizes, -places, side="left")
    return [starts[:n] + t for t, n in zip(places, active, strict=True)]


def marginals(unary: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the sum of the texts' log partition functions.
    unary: log-odds of good of each line; trans[s, t]: log weight of label t after s."""
    columns = _columns(offsets)
    fore, back = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    fore[:, 1] = unary
    lse = np.logaddexp
    for a, b in zip(columns, columns[1:], strict=False):
        prev = fore[a[: len(b)]]
        for s in (0, 1):
            fore[b, s] += lse(prev[:, 0] + trans[0, s], prev[:, 1] + trans[1, s])
    for a, b in zip(columns[-2::-1], columns[:0:-1], strict=False):
        nxt = back[b].copy()
        nxt[:, 1] += unary[b]
        for s in (0, 1):
            back[a[: len(b)], s] = lse(trans[s, 0] + nxt[:, 0], trans[s, 1] + nxt[:, 1])
    z = lse(fore[:, 0] + back[:, 0], fore[:, 1] + back[:, 1])
    good = np.exp(fore[:, 1] + back[:, 1] - z)
    moves = np.zeros((2, 2))
    for a, b in zip(columns, columns[1:], strict=False):
        a = a[: len(b)]
        for s in (0, 1):
            for t in (0, 1):
                moves[s, t] += np.exp(fore[a, s] + trans[s, t] + (unary[b] if t else 0) + back[b, t] - z[a]).sum()
    return good, moves, float(z[columns[0]].sum()) if columns else 0.0


def train(x: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict:
    """Weights by full-batch Adam on the penalised log-likelihood."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = with_neighbours(x / scale, offsets)
    y = np.repeat(labels, np.diff(offsets)).astype(np.float64)
    theta = np.zeros(x.shape[1] + 4)
    told = np.zeros((2, 2))
    for label in (0, 1):
        told[label, label] = (np.diff(offsets) - 1)[labels == label].sum()
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(len(labels), 1)
    for step in range(1, STEPS + 1):
        good, moves, _ = marginals(x @ theta[:-4], offsets, theta[-4:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - good), (told - moves).ravel()]) / n - DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"scale": scale, "weights": theta[:-4], "trans": theta[-4:].reshape(2, 2)}


def score_texts(texts: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x, size, offsets = line_features(texts)
    unary = with_neighbours(x / model["scale"], offsets) @ model["weights"]
    good, _, _ = marginals(unary, offsets, model["trans"])
    weight = np.maximum(size, 1e-3)
    return np.clip(np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]), 0, 1)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Trains on labels (doc_id, quality) outside the held-out fold, on at most about `sample` documents, those of more
    than MOST_LINES lines left out."""
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy("doc_id")
    usable = usable.agg(F.min("quality").alias("y"), F.max("quality").alias("hi")).where("y = hi").select("doc_id", "y")
    share = min(1.0, sample / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                x, _, offsets = line_features(piece.column("text"))
                short = np.diff(offsets) <= MOST_LINES
                packed = [x[a:b].astype(np.float32).tobytes() for a, b, own in zip(offsets[:-1], offsets[1:], short, strict=True) if own]
                yield pa.RecordBatch.from_arrays([piece.column("y").cast(pa.int32()).filter(pa.array(short)), pa.array(packed, pa.binary())], names=["y", "lines"])

    found = sorted((r.y, bytes(r.lines)) for r in rows.mapInArrow(run, "y int, lines binary").collect())
    y = np.array([f[0] for f in found])
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(f[1], np.float32).reshape(-1, OWN) for f in found]
    return train(np.vstack(parts).astype(np.float64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y)


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs with a column `name` (one of that name, in whatever case, is replaced); the text is read where it lies."""
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*columns)

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                scores = pa.array(score_texts(piece.column("text"), model), pa.float64())
                yield pa.RecordBatch.from_arrays([*piece.columns, scores], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    slim = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score_texts(piece.column("text"), model), pa.float64())], names=["doc_id", "score"])

    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
