import re

import numpy as np
import pyarrow as pa

from millrace.llm import textops as T

TEXTS = ["One two\tTHREE", None, "", " x ", "ÄÖ É\x0bb\x0cc\r\nD", "a" * 500 + " " + "b"] * 7


def test_split_words_of_slices():
    plain = [[w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in TEXTS]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(TEXTS, kind)
        for a, b in ((0, 42), (5, 9), (41, 1), (17, 0), (3, 30)):
            words, offsets = T.split_words(whole.slice(a, b))
            words.validate(full=True)
            got = words.to_pylist()
            assert [got[i:j] for i, j in zip(offsets[:-1], offsets[1:])] == plain[a : a + b]


def test_slices_cover_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["text", "n"])
    for most in (1, 600, 10**6):
        assert [n for s in T.slices(batch, most=most) for n in s.column("n").to_pylist()] == list(range(len(TEXTS)))


def test_shingles():
    words = [list("abcde"), list("ab"), [], list("abcab")]
    offsets = np.cumsum([0, *map(len, words)])
    h = T.hash_strings(pa.array([w for ws in words for w in ws]))
    found, at = T.shingles(h, offsets, 3)
    sets = [found[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert list(map(len, sets)) == [3, 1, 0, 3] and sets[0][0] == sets[3][0] and len({x for s in sets for x in s}) == 6
    assert T.hash_strings(pa.array([], pa.string())).size == 0
