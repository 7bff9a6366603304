import math
from collections import Counter

import pytest

from millrace.llm.mixing import mix, mixed, quotas, slot_table


def test_quotas():
    assert quotas([0.5, 0.3, 0.2], 10) == [5, 3, 2]
    assert sum(quotas([3, 1, 1e-9, 7], 100)) == 100 and min(quotas([3, 1, 1e-9, 7], 100)) == 1
    for bad in ([0.5, 0], [], [-1, 2]):
        with pytest.raises(ValueError):
            quotas(bad, 10)


@pytest.mark.parametrize("shares", [[1], [5, 5], [50, 25, 25], [7, 11, 13, 69], [1] * 10, [91, 3, 3, 3], [334, 333, 333]])
def test_schedule_stays_within_one_block(spark, shares):
    rows = sorted((r.slot, r.source_index, r.turn) for r in slot_table(spark, shares).collect())
    period, served = sum(shares), Counter()
    assert [r[0] for r in rows] == list(range(period))
    for slot, i, turn in rows:
        assert turn == served[i] and slot >= turn * period // shares[i] and slot + 1 <= -(-(turn + 1) * period // shares[i])
        served[i] += 1
        for k, a in enumerate(shares):
            assert abs(served[k] - (slot + 1) * a / period) < 1
    assert [served[i] for i in range(len(shares))] == shares


def brute(rows, weights, rest, block, period):
    import hashlib

    names = list(weights)
    shares = quotas([*weights.values(), rest], period)
    slots, done = {}, [0] * len(shares)
    for t in range(period):
        due, i = min((math.ceil((done[i] + 1) * period / a), i) for i, a in enumerate(shares) if done[i] < a and done[i] * period // a <= t)
        slots[i, done[i]] = t
        done[i] += 1
    groups = {}
    for d, s in rows:
        groups.setdefault(names.index(s) if s in names else len(names), []).append(d)
    out = []
    for g, ids in groups.items():
        key = lambda d: (hashlib.md5(str(d).encode()).hexdigest() if d is not None else "0000", d or 0)
        for rank, d in enumerate(sorted(ids, key=key)):
            j = rank // block
            out.append((d, g, j, j // shares[g] * period + slots[g, j % shares[g]], rank % block))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)] + [(900, None), (901, "unheard"), (None, "hot"), (5, "s5"), (5, "s5")]
    docs = spark.createDataFrame([(d, s, "x") for d, s in rows], "doc_id long, source string, slot string")
    weights = {"hot": 0.2, "s1": 0.3, "s2": 0.25}
    got = [(r.row.doc_id, r.source_index, r.block, r.slot, r.place) for r in mix(docs, weights, 0.25, block=4, period=20).collect()]
    assert sorted(got, key=str) == brute(rows, weights, 0.25, 4, 20)


def test_mixed_keeps_rows_columns_and_order(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2], "clash") for i in range(200)], "doc_id long, text string, source string, place string")
    out = mixed(docs, {"a": 3, "b": 1}, 1e-6, block=5, period=8)
    rows = out.collect()
    assert out.columns == docs.columns and sorted(map(tuple, rows)) == sorted(map(tuple, docs.collect()))
    first = Counter(r.source for r in rows[:35])
    assert first["a"] >= 20 and first["b"] >= 5


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string"), {"a": 1}, 1).collect() == []
