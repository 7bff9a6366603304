"""Vectorised word and shingle hashing over Arrow string arrays, used inside tasks."""

from __future__ import annotations

import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    return np.uint64(n * int(STEP) % 2**64)


def odd_factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def whole(texts: pa.Array) -> pa.Array:
    """The texts as large strings in buffers of their own, nulls as empty. Kernels that map bytes, such as
    ascii_lower, misread arrays whose first offset is not 0, as slices are after a cast."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), data)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between the ASCII white space of every text, A-Z lower-cased; word array and the offsets of each text."""
    texts = whole(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    words, offsets = words.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py() and len(words):
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        words, offsets = words.filter(full), kept[offsets]
    return words, offsets.astype(np.int64)


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string; every distinct string of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return own.astype(np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of each text; a text with fewer words has its whole sequence as one.

    Returns the hashes in text order and their offsets; a text without words has none.
    """
    count = np.diff(offsets)
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    factors, n = odd_factors(width), len(h)
    if n >= width:
        windows = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            windows += h[i : n - width + 1 + i] * factors[i]
        windows = mix(windows + salt(width))
        starts = offsets[:-1][count >= width]
        lens = many[count >= width]
        at = np.arange(lens.sum(), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)
        body = windows[at]
    else:
        body = np.zeros(0, np.uint64)
    out = np.empty(out_offsets[-1], np.uint64)
    long_mask = np.repeat(count >= width, many)
    out[long_mask] = body
    for d in np.flatnonzero((count > 0) & (count < width)):
        part = h[offsets[d] : offsets[d + 1]]
        whole = (part * factors[: len(part)]).sum(dtype=np.uint64, keepdims=True)
        out[out_offsets[d]] = mix(whole + salt(len(part)))[0]
    return out, out_offsets


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """The batch in runs of rows of about `most` bytes of the column (a longer row is a run of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # what long texts took would stay with the worker


def held(key: tuple, make):
    """A value kept for the life of the Python worker, which runs many tasks."""
    kept = sys.modules.setdefault("_millrace_held", types.ModuleType("_millrace_held")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
