"""Approximate search against brute force: recall, exact scores, copies and odd vectors."""

import math

import numpy as np
import pytest

from millrace.llm.vector_ann import fitted, nearest, rotation, search

DDL = "vec_id long, embedding array<float>, score string"


def brute(queries, rows, k):
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, v) for i, v in rows if i is not None and usable(v)]
    found = {}
    for q, v in queries:
        if q is None or not usable(v):
            continue
        scored = [(-float((np.array(v, np.float64) * np.array(w, np.float64)).sum()), i) for i, w in rows if i != q and len(w) == len(v)]
        found[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return found


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = found.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return found


def recall(found, want):
    return sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "norms"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(20, 48)).astype(np.float32)[rng.integers(20, size=3000)]
    if kind == "norms":
        x *= rng.lognormal(size=(3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, DDL).repartition(3)
    found = result(search(frame.where("vec_id % 20 = 0"), frame, k=20))
    want = brute([r[:2] for r in rows if r[0] % 20 == 0], [r[:2] for r in rows], 20)
    assert recall(found, want) >= 0.9
    for q, own in found.items():
        assert len(own) == 20 and own == sorted(own, key=lambda r: (-r[1], r[0]))
        for i, score in own:
            assert score == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)), rel=1e-12, abs=1e-12)


def test_copies_are_whole_and_in_order(spark):
    rng = np.random.default_rng(6)
    common = [1.0] + [0.0] * 15
    rows = [(i, common, "x") for i in range(1000)] + [(1000 + i, v.tolist(), "x") for i, v in enumerate(rng.normal(size=(400, 16)).astype(np.float32) * 0.1)]
    frame = spark.createDataFrame(rows, DDL)
    found = result(search(frame.where("vec_id in (0, 5, 40, 1000)"), frame, k=20))
    assert [i for i, _ in found[0]] == list(range(1, 21)) and [i for i, _ in found[5]] == [i for i in range(21) if i != 5]
    assert found[40] == [(i, 1.0) for i in range(20)]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.25, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 2.0]), (10, [1.0] * 3), (11, [2.0] * 3), (12, [1.0] * 700)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], DDL)
    found = result(search(frame, frame, k=5))
    want = brute([(2, [0.25, 0.0])] + [r for r in rows if r[0] != 2], rows, 5)
    assert found == {q: own for q, own in want.items() if own}
    assert [i for i, _ in found[1]] == [2, 2, 2, 9]
    none = frame.where("false")
    assert result(search(none, none)) == {} and result(search(none, frame)) == {} and result(search(frame, none)) == {}


def test_large_components(spark):
    rows = [(i, [float(10 ** (150 + i)), 1.0, float(i)], "x") for i in range(6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = result(search(frame.where("vec_id = 0"), frame, k=2))
    assert [i for i, _ in found[0]] == [5, 4]


def test_parts():
    turn = rotation(20)
    assert np.allclose(turn @ turn.T, np.eye(20))
    x = np.random.default_rng(1).normal(size=(500, 8))
    c = fitted(x.copy(), 10)
    assert c.shape == (10, 8) and (nearest(x, c) == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
