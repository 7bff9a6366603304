"""Token-ID output: ids bit-packed at the least width that the vocabulary needs, in self-contained shards.

A shard is one binary value: a header, the id and the number of tokens of each document, the byte offset of
each block of BLOCK ids, and the blocks, each packed at `bits` bits an id (little-endian bit order). Any range
of tokens unpacks from its own blocks alone, by numpy. Shards are rows of a Parquet table with their place in
the order, so that Spark's file systems hold them and readers skip to the shards they want.

Documents are dealt out by range of their order, sorted within partitions and encoded there; only the token
count of each partition (one row a partition) is gathered to number tokens over all partitions.

Defined results: a null or empty text encodes to the end id alone. Rows with a null id come first and keep it.
Rows that repeat an id are all written, ordered by text. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, small_batches
from millrace.llm.textops import held, slices, split_words, whole

MAGIC, HEAD, BLOCK, SHARD_TOKENS = b"MRTOK1", "<6sBxIQ", 4096, 1 << 20
SHARDS = "part long, seq long, part_start long, n_docs long, n_tokens long, shard binary"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([struct.pack(HEAD, MAGIC, bits, len(doc_ids), len(ids)), known.tobytes(), numbers.tobytes(), counts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reader of one shard; `tokens` unpacks only the blocks that a range touches."""

    def __init__(self, data: bytes):
        magic, self.bits, n_docs, self.n_tokens = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        known = np.frombuffer(data, np.uint8, n_docs, at)
        numbers = np.frombuffer(data, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.counts = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        n_blocks = -(-self.n_tokens // BLOCK)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64) + at + 8 * (n_blocks + 1)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.data = memoryview(data)

    def tokens(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        n = min(self.n_tokens, (last + 1) * BLOCK) - first * BLOCK
        if self.bits in (8, 16, 32) or first == last:
            got = unpack(self.data[self.offsets[first] : self.offsets[last + 1]], n, self.bits)
        else:
            got = np.concatenate([unpack(self.data[self.offsets[b] : self.offsets[b + 1]], min(self.n_tokens - b * BLOCK, BLOCK), self.bits) for b in range(first, last + 1)])
        return got[start - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def _tokenizer(path: str):
    def make():
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        return Tokenizer.from_file(path)

    return held(("tokenizer", path), make)


class WordIds:
    """Ids of words, kept by the Python worker over its tasks; begun anew beyond `most` words, so memory is bounded.

    Words of Latin letters are one token of the pre-tokenizer each, so LINE of them are encoded as one text, and parted
    where a token ends a word, if the vocabulary marks those.
    """

    LINE, LETTERS, ENDING = 256, re.compile("[a-zÀ-ÖØ-öø-ÿ]+"), "</w>"

    def __init__(self, tokenizer, most: int = 300_000):
        self.tokenizer, self.most = tokenizer, most
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.ENDING)]] = True
        self.clear()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for e in encoded for i in e.ids), np.uint32, int(lens.sum())), lens

    def _encoded_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        lines = [words[i : i + self.LINE] for i in range(0, len(words), self.LINE)]
        for own, encoded in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            whole = len(ends) == len(own) and ends[-1] == len(ids)
            found.append((ids, np.diff(ends, prepend=0)) if whole else self._encoded(own))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.lens, self.flat, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def lookup(self, words: list[str]) -> np.ndarray:
        """Code of each word; words are distinct."""
        if len(self.codes) + len(words) > self.most:
            self.clear()
        fresh = [w for w in words if w not in self.codes]
        plain = [w for w in fresh if self.LETTERS.fullmatch(w)] if self.ends.any() else []
        new = plain + [w for w in fresh if not self.LETTERS.fullmatch(w)] if plain else fresh
        parts = ([self._encoded_lines(plain)] if plain else []) + [self._encoded(new[len(plain) :])]
        ids, lens = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.lens = np.concatenate([self.lens, lens])
        return np.fromiter((self.codes[w] for w in words), np.int64, len(words))


def encode(texts: pa.Array, path: str, end_id: int, by_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, the end id after each, and the count of each text.

    by_word: for vocabularies that fold case and whose pre-tokenizer drops white space and parts letters from
    punctuation, so that a text's ids are those of its words; each distinct word is then encoded once.
    """
    tokenizer = _tokenizer(path)
    texts = whole(texts)
    if by_word and len(texts):
        lower = pc.ascii_lower(texts)  # what the words are taken from; a text may spell a special token in capitals
        marks = [pc.match_substring(lower, t.content.lower()).to_numpy(zero_copy_only=False) for t in tokenizer.get_added_tokens_decoder().values()]
        marked = np.any(marks, axis=0) if marks else np.zeros(len(texts), bool)
        if marked.any():  # texts that spell a special token, in whatever case, are encoded whole
            cuts = np.flatnonzero(np.diff(marked)) + 1
            runs = [encode(texts.slice(a, b - a), path, end_id, not marked[a]) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True)]
            return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        # punctuation after an ASCII letter is a word of its own (but for apostrophes, which contractions hold)
        texts = pc.replace_substring_regex(lower, r"([a-z])([!-&(-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")
        words, offsets = split_words(texts, lower=False)
        coded = words.dictionary_encode()
        known = held(("words", path), lambda: WordIds(tokenizer))
        codes = known.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lens, flat = known.lens, known.flat
    else:
        lists = [e.ids for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        codes, offsets = np.arange(len(lists)), np.arange(len(lists) + 1)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(lens.sum()))
    begins = np.cumsum(lens) - lens
    each = lens[codes] if len(lens) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(each)])
    counts = before[offsets[1:]] - before[offsets[:-1]] + 1
    ids = np.full(int(counts.sum()), end_id, np.uint32)
    body = np.ones(len(ids), bool)
    body[np.cumsum(counts) - 1] = False
    ids[body] = flat[np.arange(before[-1]) - np.repeat(before[:-1], each) + np.repeat(begins[codes], each)] if len(each) else 0
    return ids, counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: list[str], vocabulary: int, end_id: int = 1, by_word: bool = True) -> DataFrame:
    """Writes the shards of docs (doc_id, text, order columns) in ascending order to the folder `path`; the shard table."""
    bits = width_of(vocabulary)

    def run(batches):
        part, seq, start, kept, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def shard():
            nonlocal seq, start, kept, size
            ids = np.concatenate([k[2] for k in kept])
            docs = [d for k in kept for d in k[0]]
            row = [part, seq, start, len(docs), len(ids), write_shard(docs, np.concatenate([k[1] for k in kept]), ids, bits)]
            seq, start, kept, size = seq + 1, start + len(ids), [], 0
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for piece in slices(batch):
                ids, counts = encode(piece.column("text"), tokenizer, end_id, by_word)
                kept.append((piece.column("doc_id").to_pylist(), counts, ids))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield shard()
        if kept:
            yield shard()

    keys = list(dict.fromkeys([*order, "text"]))
    dealt = docs.repartitionByRange(*[F.col(c).asc() for c in order]).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def run(batches):
        for batch in batches:
            for part, start, data in zip(*(batch.column(c) for c in ("part", "part_start", "shard")), strict=True):
                shard = Shard(data.as_py())
                ids = shard.tokens(0, shard.n_tokens).astype("<u4")
                cuts = shard.starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(crc), pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(cuts[:-1] + start.as_py(), pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "part_start", "shard").mapInArrow(run, "part long, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row a partition, however many tokens
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, vocabulary: int, order: list[str] | None = None, end_id: int = 1, by_word: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Encodes docs, writes them as shards to the shared folder and reads them back."""
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    small_batches(docs.sparkSession)
    path = f"{scratch.path}/shards"
    write_tokens(docs, path, tokenizer, order or ["doc_id"], vocabulary, end_id, by_word)
    return read_tokens(docs.sparkSession, path)
