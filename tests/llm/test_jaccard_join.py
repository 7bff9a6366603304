import re

import numpy as np
import pytest

from millrace.llm import jaccard_join
from millrace.llm.common import Scratch, renamed, unsettled
from millrace.llm.jaccard_join import _tell, bands, jaccard_components, may_link, need, plan, signatures, sketch


def shingle_set(text, w):
    words = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(words[i : i + w]) for i in range(max(len(words) - w + 1, 1))} if words else set()


def brute(rows, w, num, den):
    sets = [(d, shingle_set(t, w)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted((d, len(x), root(d)) for d, x in sets)


def run(spark, rows, w, num, den=100):
    docs = spark.createDataFrame([(d, t, 0, "c") for d, t in rows], "doc_id long, text string, node int, sig string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, w, num, den).collect())


def corpus(rng, n_base, n, common):
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    passage = list(rng.choice(vocabulary, 40))
    base = [list(rng.choice(vocabulary, int(rng.integers(1, 120)))) + (passage if rng.random() < common else []) for _ in range(n_base)]
    rows = []
    for i in range(n):
        words = list(base[int(rng.integers(n_base)) if rng.random() < 0.7 else 0])  # one large group
        for _ in range(int(rng.choice([0, 0, 1, 2, 6]))):
            words[int(rng.integers(len(words)))] = "edit" + str(rng.integers(5))
        rows.append((int(i * 7 % 1009), " ".join(words) if rng.random() < 0.9 else "\n".join(words).upper()))
    return rows


@pytest.mark.parametrize("w,num,seed,tile", [(3, 90, 0, 512), (5, 80, 1, 512), (5, 80, 2, 5)])
def test_equals_brute_force(spark, monkeypatch, w, num, seed, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = corpus(np.random.default_rng(seed), 60, 260, 0.4)
    assert run(spark, rows, w, num) == brute(rows, w, num, 100)


def test_many_documents_of_one_passage(spark):
    """Most of every document is the same passage, but only few link: groups that rounds of leaders don't settle."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"u{i}x{j}" for j in range(12)]
        rows.append((i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(passage + own[:-1] + ["z"])))
    rows += [(3000 + i, " ".join(rng.permutation(passage)[:2])) for i in range(5)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "a b c"), (9, "A\x0bB\x0cC"), (10, "a b c d"), (11, "x " * 30_000), (12, "x x x")]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90, 100)
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in jaccard_components(docs).collect()] == [(1, 1, 1)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def offsets(sets):
    return np.concatenate([[0], np.cumsum([len(s) for s in sets])])


@pytest.mark.parametrize("num", [80, 90])
def test_similar_sets_share_signatures(num):
    """As many as `need` says, of the smaller set's band: what leaves a candidate out for having fewer relies on it."""
    rng = np.random.default_rng(num)
    table, least = bands(3000, num, 100), 99
    for _ in range(600):
        n = int(rng.integers(1, 700))
        common = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        spare = n * (100 - num) // num
        split = int(rng.integers(0, spare + 1))
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (split, spare - split))
        if len(x) > len(y):
            x, y = y, x
        if not split and not spare or np.array_equal(x, y):
            continue
        at = [next(i for i, b in enumerate(table) if b[0] <= len(s) <= b[1]) for s in (x, y)]
        assert at[1] - at[0] in (0, 1)
        b = at[0]
        both = signatures(np.concatenate([x, y]), offsets([x, y]), b, table[b][2])
        shared = np.intersect1d(both[0], both[1]).size
        assert shared >= need(table[b][2])
        least = min(least, shared - need(table[b][2]))
    assert least < 3


def test_sketches_lose_no_link():
    rng, sets = np.random.default_rng(3), []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(1, 400) if len(sets) < 40 else rng.integers(150, 250)), dtype=np.uint64)
        for _ in range(4):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    own = [(sketch(s), len(s)) for s in sets]
    near = may_link(own, own, 80, 100)
    common = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    sizes = np.array([len(s) for s in sets])
    link = 100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)
    assert not (link & ~near).any()
    own, link = own[60:], link[60:, 60:]  # sketches of much smaller sets would be short
    near = may_link(own, own, 80, 100)
    assert not (link & ~near).any() and link.sum() > 300 and near.sum() < 2 * link.sum()


def test_plans_cover_the_differences():
    for k in [*range(1, 200), 1_000, 5_000]:
        n1, n2, k2 = plan(k)
        assert (n1 - need(k) + 1) * (k2 + 1) > k and 0 <= k2 < n2
        assert k2


def test_frequent_signatures_are_told_as_they_come(monkeypatch):
    """One signature of most rows, in many small batches: a task keeps a row of it, and no owner is lost."""
    rng = np.random.default_rng(0)
    sig = np.where(rng.random(3_000) < 0.7, 7, rng.integers(0, 1_000, 3_000)).astype(np.uint64)
    owner = rng.integers(0, 900, 3_000).astype(np.uint64)
    kept, told = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)), set()
    for i in range(0, 3_000, 100):
        both = [np.concatenate([k, x[i : i + 100]]) for k, x in zip(kept, (sig, owner))]
        said, kept = _tell(*both, np.concatenate([kept[2], np.zeros(100, bool)]))
        told |= set(zip(*(x.tolist() for x in said)))
        assert len(kept[0]) == len(set(sig[: i + 100].tolist()))
    owners = {}
    for s, o in zip(sig.tolist(), owner.tolist()):
        owners.setdefault(s, set()).add(o)
    assert told == {(s, o) for s, own in owners.items() if len(own) > 1 for o in own}


@pytest.mark.parametrize("tile", [128, 5])
def test_every_link_is_counted(spark, monkeypatch, tile):
    """Against all pairs: links inside a component that joined nothing, copies, and tiles that meet."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = corpus(np.random.default_rng(5), 40, 200, 0.4)
    rows = list({d: (d, t) for d, t in rows}.values()) + [(2000, None), (2001, "alone in all of this"), (2002, "a b c d e f"), (2003, "A B C D E F")]
    sets = {d: shingle_set(t, 3) for d, t in rows}
    want = {d: sum(d != e and bool(x) and bool(y) and 100 * len(x & y) >= 90 * len(x | y) for e, y in sets.items()) for d, x in sets.items()}
    assert max(want.values()) > 10 and want[2002] == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard_components(docs, 3, 90, 100).collect()} == want


def test_rows_of_large_balls_do_not_follow_their_groups(spark, monkeypatch):
    """Sets of one leader's ball that share many groups with it and have no link, and a few that link across tiles: what
    is looked up again is a row for each of the sets, not for each group, and only where there may be a link."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    held = []
    monkeypatch.setattr(jaccard_join, "renamed", lambda df, merged: held.append(df.count()) or renamed(df, merged))
    monkeypatch.setattr(jaccard_join, "unsettled", lambda df: held.append(df.count()) or unsettled(df))
    rng, sets = np.random.default_rng(7), {}
    for i in range(60):
        sets[i] = np.sort(rng.integers(1, 2**62, 40))
    for i in range(1, 60, 2):
        if i % 3 == 0:
            sets[i] = np.sort(np.concatenate([sets[i - 1][:38], rng.integers(1, 2**62, 2)]))
    groups = [(s, i, 20, 1) for s in range(30) for i in sets]
    frame = spark.createDataFrame([(i, len(x), x.tolist(), bytearray(sketch(x.astype(np.uint64)))) for i, x in sets.items()], "node long, n long, elements array<long>, sketch binary")
    live = spark.createDataFrame(groups, "sig long, node long, need long, many long")
    found = jaccard_join.settle(live, frame, 80, 100, Scratch(spark, "test"))
    assert sorted(map(tuple, found.collect())) == sorted((j, i - 1) for i in range(1, 60, 2) if i % 3 == 0 for j in (i - 1, i))
    assert 0 < max(held) <= len(sets)
