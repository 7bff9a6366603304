import numpy as np
import pytest

from millrace.llm.vector_topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=1024):
    usable = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    asked = {}
    for i, v in usable:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, SCHEMA)
    found = top_k(df.where("vec_id % 100 = 0"), df, k).collect()
    return {tuple(r) for r in found}, len(found)


@pytest.mark.parametrize("dim,n,seed", [(64, 1500, 0), (7, 400, 1), (33, 300, 2)])
def test_equals_brute_force(spark, dim, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    vectors = centres[rng.integers(0, 5, n)] * 0.1 + rng.normal(size=(n, dim)) * 0.05
    vectors[n // 3 : n // 2] = vectors[0]  # a large group of copies, all ties
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    found, n_rows = run(spark, rows)
    assert found == brute(rows, 10) and n_rows == len(found)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 0), (1, [0.5, -0.25], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0),
        (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [], 0), (100, [1e30, 1.0], 0), (101, [-3e9, 2.0], 0), (200, [1.0, 2.0], 0), (7, [1.0, 1.0, 1.0], 0),
    ]
    found, _ = run(spark, rows, 3)
    assert found == brute(rows, 3)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (5, [0.5, 0.0], 0), (5, [0.5, 0.0], 0), (9, [0.1, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, 10).collect())
    assert got == [(0, 1, 5, 1024 * 512), (0, 2, 5, 1024 * 512), (0, 3, 9, 1024 * 102)]


def test_empty(spark):
    assert run(spark, []) == (set(), 0)
