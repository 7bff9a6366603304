import numpy as np

import pytest

from millrace.llm import jaccard_join as J
from millrace.llm.line_dedup import SMALL, characters, common, dedup_lines, windows


def grams(line, w=5):
    return {line[i : i + w] for i in range(max(len(line) - w + 1, 1))}


def brute(rows, links=True):
    """Rows after deduplication, by comparing every pair of distinct lines."""
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\r"):
                first.setdefault(line, (d is not None, d or 0, i))
    lines = list(first)
    parent = dict(zip(lines, lines))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: grams(x) for x in lines if len(x) >= 5}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if a in sets and b in sets and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    keep = {}
    for x in lines:
        keep[root(x)] = min(keep.get(root(x), first[x]), first[x])
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        parts = t.split("\n")
        stay = [x for i, x in enumerate(parts) if not x.strip(" \t\r") or keep[root(x)] == (d is not None, d or 0, i)]
        out.append((d, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, line string")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pool = [sentence(rng, int(rng.integers(3, 40))) for _ in range(60)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(int(rng.integers(1, 8))):
            line = pool[rng.integers(60)]
            if rng.random() < 0.5:  # a near copy
                at = int(rng.integers(len(line)))
                line = line[:at] + "#" + line[at + 1 :]
            lines.append(line if rng.random() < 0.9 else "")
        rows.append((d, "\n".join(lines + (["a very common line of text"] if d % 3 else []))))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    line = "the same line of words once more"
    rows = [(5, line), (5, line), (None, line), (7, None), (8, ""), (9, "\n\n \t\n"), (10, "ab\nab\nabc\n\n"), (11, "x" * 2000 + "\n" + "x" * 2001), (12, "é" * 3 + "\r\n" + "é" * 3 + "\r")]
    assert run(spark, rows) == brute(rows)


def test_very_long_line(spark):
    rng = np.random.default_rng(4)
    line = sentence(rng, 20_000)
    rows = [(1, line), (2, line[:50_000] + "changed" + line[50_000:]), (3, sentence(rng, 20_000))]
    got = {d: n for d, _, _, n in run(spark, rows)}
    assert got == {1: 0, 2: 1, 3: 0}


def test_long_lines_of_few_shingles(spark):
    """Rulers and repeated phrases: however long, near copies have the same few shingles."""
    units = ["-", "*", ".", "-=", "la ", "| --- ", "buy now! "]
    rows, d = [], 0
    for n in (260, 300, 5_000, 100_000):
        for u in units:
            line = u * (n // len(u))
            rows += [(d, line), (d + 1, line + u[0])]
            d += 2
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(n for *_, n in got) == len(rows) - len(units)


@pytest.mark.parametrize("similarity,least", [(0.8, 0.95), (0.85, 0.97), (0.9, 0.99)])
def test_recall(spark, similarity, least):
    """Pairs of just this similarity, by how often one of the two goes."""
    rng, rows = np.random.default_rng(int(100 * similarity)), []
    for k in range(400):
        line = list(sentence(rng, int(rng.integers(12, 60))))
        other = line.copy()
        while True:  # edits until one more would be too many
            at = int(rng.integers(len(other)))
            edited = other[:at] + [chr(0x400 + int(rng.integers(400)))] + other[at + 1 :]
            x, y = grams("".join(line)), grams("".join(edited))
            if len(x & y) < similarity * len(x | y):
                break
            other = edited
        rows += [(2 * k, "".join(line)), (2 * k + 1, "".join(other))]
    found = sum(n for *_, n in run(spark, rows))
    assert least * 400 <= found <= 400


def test_groups_that_leaders_do_not_settle(spark, monkeypatch):
    """Many lines of one base, near one another and far: compared in tiles, which must find all that pairs would."""
    monkeypatch.setattr(J, "TILE", 7)
    rng, base, rows = np.random.default_rng(6), sentence(np.random.default_rng(5), 30), []
    for d in range(120):
        line = list(base)
        for at in rng.integers(0, len(line), int(rng.integers(0, 14))):
            line[at] = chr(0x400 + int(rng.integers(30)))
        rows.append((d, "".join(line)))
    assert sum(a != b for a, b in zip(run(spark, rows), brute(rows))) <= 2  # what banding may miss


def pair_of(rng, size, similarity):
    """A line with about this many shingles, and one like it, just as similar as asked for."""
    line = "".join(rng.choice(list("abcdefghijklmnop "), size + 4))
    other, nearest = line, None
    for _ in range(200):
        at = int(rng.integers(len(other) + 1))
        edited = [other[:at] + "#", other[:at] + other[at + 1 :], other[:at] + "+" + other[at:]][rng.integers(3)]
        edited = edited if len(edited) > len(other) // 2 else other + "!"
        x, y = grams(line), grams(edited)
        if edited != line and len(x & y) >= similarity * len(x | y):
            other = nearest = edited
    return line, nearest or line + "!"


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
@pytest.mark.parametrize("size", [5, 6, 8, 10, 14, 20, 28, 36, 42, 50, 60, 90])
def test_shared_windows_by_size(size, similarity):
    """Of pairs of this similarity, how many share a window: all of small sets."""
    import pyarrow as pa

    rng = np.random.default_rng(size)
    pairs = [pair_of(rng, size, similarity) for _ in range(400)]
    pairs = [p for p in pairs if len(grams(p[0]) & grams(p[1])) >= similarity * len(grams(p[0]) | grams(p[1]))]
    if not pairs:  # no two sets of this size are as similar
        return
    sides = []
    for side in zip(*pairs, strict=True):
        found = [windows(pa.array(side[i : i + 100]), 5) for i in range(0, len(side), 100)]
        sides.append([set(sig[a:b].tolist()) for _, sig, at in found for a, b in zip(at[:-1], at[1:], strict=True)])
    met = sum(bool(a & b) for a, b in zip(*sides, strict=True))
    small = size <= SMALL - 8
    assert met == len(pairs) if small else met >= 0.95 * len(pairs)


def test_short_lines(spark):
    """A line of 5 shingles and the same without its last character share 4 of 5."""
    rng = np.random.default_rng(9)
    rows = []
    for d in range(300):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
        rows += [(2 * d, line), (2 * d + 1, line[:-1])]
    got = run(spark, rows)
    assert got == brute(rows) and sum(n for *_, n in got) == 300


def test_sets_of_characters():
    import pyarrow as pa

    lines = ["", "ab", "naïve Été 日本語 x", "🙂🙂🙂🙂🙂🙂", "aaaaaaaa", "plain line"]
    found, at = characters(pa.array(lines))
    assert np.diff(at).tolist() == [len(x) for x in lines] and len({*found.tolist()}) == len({*"".join(lines)})
    other = ["x", "ab", "naïve été 日本語 x", "🙂🙂🙂🙂🙂", "aaaaaaab", "plain line"]
    m, n, both = common(pa.array(lines), pa.array(other), 5)
    full = lambda x: grams(x) if len(x) >= 5 else set()
    assert [m.tolist(), n.tolist(), both.tolist()] == [[len(full(x)) for x in lines], [len(full(x)) for x in other], [len(full(x) & full(y)) for x, y in zip(lines, other, strict=True)]]


def test_clashing_columns(spark):
    ddl = "doc_id long, text string, _gone string, _id string, line string, N_lines int, gone int, row int, whole int, id int"
    rows = [(i, "the same line of words once more", "g", "i", "l", 7, 1, 2, 3, 4) for i in range(3)]
    out = dedup_lines(spark.createDataFrame(rows, ddl))
    assert out.columns == ["doc_id", "text", "_gone", "_id", "line", "gone", "row", "whole", "id", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.n_removed, r._gone, r.id) for r in out.collect()) == [(0, 0, "g", 4), (1, 1, "g", 4), (2, 1, "g", 4)]


def test_document_of_many_lines(spark):
    rows = [(1, "\n".join(f"line number {i:09d} is its own {i * 7919 % 100003}" for i in range(20_000))), (2, "\n".join(["all the same words again"] * 50_000))]
    got = {d: (n, r) for d, _, n, r in run(spark, rows)}
    assert got[2] == (50_000, 49_999)


def test_empty_table(spark):
    assert run(spark, []) == []
