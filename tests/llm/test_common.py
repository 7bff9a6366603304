import numpy as np
import pytest

from millrace.llm.common import Scratch, connected_components, shared_dir


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in list(parent)}


class Counting(Scratch):
    rounds = 0

    def save(self, df, label, partition_by=()):
        self.rounds += "-moves-" in label
        return super().save(df, label, partition_by)


def run(spark, edges, kind="long"):
    scratch = Counting(spark, "test")
    frame = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    got = {r.node: r.component for r in connected_components(frame, scratch, "cc").collect()}
    return got, scratch.rounds


def test_a_shuffled_chain(spark):
    at = [int(x) for x in np.random.default_rng(1).permutation(5_000)]
    edges = list(zip(at, at[1:]))
    got, rounds = run(spark, edges)
    assert got == union_find(edges) and rounds < 20


def test_stars_and_small_groups(spark):
    rng = np.random.default_rng(2)
    star = [(3_000, i) for i in range(3_000)]
    small = [(10_000 + 5 * g + int(a), 10_000 + 5 * g + int(b)) for g in range(1_000) for a, b in rng.integers(0, 5, (4, 2)) if a != b]
    got, rounds = run(spark, star + small)
    assert got == union_find(star + small) and rounds < 20


def test_sorted_chain_of_names_and_odd_edges(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)] + [("x", "x"), ("y", None), (None, None), ("p", "q"), ("q", "p"), ("p", "q")]
    got, rounds = run(spark, edges, "string")
    assert got == union_find([e for e in edges if None not in e and e[0] != e[1]]) and rounds < 20
    assert run(spark, []) == ({}, 0)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster())
