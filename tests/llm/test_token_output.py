import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import token_output as T
from millrace.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "Don't stop, it's 3.5% O'Neil's!?", "a,b;c...d--e", "ÀÉÎ ñandú,; l'été…", "x y z", "tab\tnew\nline\r\nend.", "日本語テキスト。混在 text,", "😀 emoji!! ok",
    "éä.", "ΑΣ ΣΑΣ", "KK İstanbul", "under_score a_ _b [x] {y} `z`", "<|endoftext|> </w>", "a<|EndOfText|>b", "<|STARTOFTEXT|> X", "word" * 3000, "don't'", "''s 's's", "1,2 3.", "\x0b\x0c v",
]


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(text):
    return whole_tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def test_encode_equals_whole_text_encoding():
    rng = np.random.default_rng(0)
    alphabet = list("abzABZ09éÉñ '’.,;:!?-_()\n\t\"%$&") + ["ion", "the ", "'s", "…", "́"]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(400)]
    for by_word in (True, False):
        ids, counts = T.encode(pa.array(texts), PATH, 1, by_word)
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == plain(t), repr(t)


def test_word_cache_begins_anew():
    known = T.WordIds(T._tokenizer(PATH), most=3)
    for words in (["one", "two"], ["two", "three"], ["four", "one"]):
        codes = known.lookup(words)
        begins = np.cumsum(known.lens) - known.lens
        assert [known.flat[begins[c] : begins[c] + known.lens[c]].tolist() for c in codes] == [plain(w)[:-1] for w in words]


@pytest.mark.parametrize("vocabulary", [2, 3, 256, 257, 49_408, 65_536, 65_537, 2**20, 2**32])
def test_packing_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary % 97)
    bits = T.width_of(vocabulary)
    counts = np.array([0, 5, 1, 9_000, 4_096, 0, 17])
    ids = rng.integers(0, vocabulary, counts.sum(), dtype=np.uint64).astype(np.uint32)
    shard = T.Shard(T.write_shard([3, None, 7, 8, 9, 10, 11], counts, ids, bits))
    assert shard.doc_ids == [3, None, 7, 8, 9, 10, 11] and shard.n_tokens == len(ids)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        assert (shard.document(i) == ids[a:b]).all()
    for a, b in ((0, 1), (4_000, 4_200), (4_096, 8_192), (8_191, 12_290), (len(ids) - 1, len(ids)), (5, 5)):
        assert (shard.tokens(a, b) == ids[a:b]).all()
    assert len(shard.data) < 200 + 30 * len(counts) + len(ids) * bits / 8 + 16 * (len(ids) / T.BLOCK + 1)


def test_operator_against_plain_encoding(spark):
    rows = [(i * 3 % 41, t, "clash") for i, t in enumerate(ODD * 2)] + [(None, "lost id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = [tuple(r) for r in T.token_output(docs, PATH, 49_408).collect()]
    at, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = plain(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_shards_are_files_with_random_access(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(50)], "doc_id long, text string")
    path = Scratch(spark, "t").path
    T.write_tokens(docs, path, PATH, ["doc_id"], 49_408)
    for row in T.read_tokens.__globals__["SparkSession"].active().read.parquet(path).collect():
        shard = T.Shard(bytes(row.shard))
        for i, d in enumerate(shard.doc_ids):
            assert shard.document(i).tolist() == plain(f"text number {d} " * (d % 7))


def test_empty_table(spark):
    assert T.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH, 49_408).collect() == []
