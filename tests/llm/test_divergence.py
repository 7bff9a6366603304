"""The divergence audit against counts in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from millrace.llm import divergence as D
from millrace.llm.divergence import SCALE, Leaves, differ, divergence, merged, terms_of, trie, walk, weights

DOCS = "doc_id long, text string, lang string, source string, item string"


def plain(docs, least=3, most=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, groups, found = defaultdict(Counter), defaultdict(set), []
    seen = defaultdict(Counter)
    for _, text, lang, source, _ in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
        groups[lang].add(source)
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        by = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        every = {t: sum(c[t] for c in by.values()) for t in kept}
        p = lambda c: {t: 1 + SCALE * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        ps, q = {s: p(c) for s, c in by.items()}, p(every)
        for s in sources:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if by[s][t] and ps[s][t] > q[t]]
            for part, rows, cut in (("pair", pairs, None), ("term", terms, most)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                found += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(rows[:cut], 1)]
    return sorted(found)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_tries_walk_in_the_order_of_bytes():
    rng = random.Random(1)
    terms = ["".join(rng.choices("abé日", k=rng.randrange(1, 6))).encode() for _ in range(2000)] + [b"a" * 5000, b"a" * 4999]
    parts, want = [], defaultdict(Counter)
    for i in range(4):
        own = sorted({*rng.choices(terms, k=700), b"a" * 5000})
        counts = [{s: rng.randrange(1, 9) for s in rng.sample(range(5), rng.randrange(1, 4))} for _ in own]
        at = np.cumsum([0, *map(len, counts)])
        parts.append(Leaves(pa.array(own, pa.large_binary()), np.full(len(own), i), at, np.array([s for c in counts for s in c]), np.array([n for c in counts for n in c.values()])))
        for t, c in zip(own, counts, strict=True):
            want[t].update(c | {"docs": i})
    both = merged(parts, 5)
    names: dict[str, int] = {}
    found = walk(trie("en", both, list("abcde")), names)
    assert found.terms.to_pylist() == sorted(want)
    by = {n: "abcde".index(s) for s, n in names.items()}
    for i, t in enumerate(found.terms.to_pylist()):
        own = slice(found.at[i], found.at[i + 1])
        assert {by[s]: n for s, n in zip(found.source[own].tolist(), found.counts[own].tolist(), strict=True)} | {"docs": found.docs[i]} == dict(want[t])


def test_terms():
    texts = ["", None, "A-b  Cd", "É1ÀB@[`{\x7f", "x", "y", "日本 ÀÉ"]
    terms, text = terms_of(pa.array(texts))
    assert [(i, t.decode()) for i, t in zip(text.tolist(), terms.to_pylist())] == [(2, "a"), (2, "b"), (2, "cd"), (3, "É"), (3, "Àb"), (4, "x"), (5, "y"), (6, "日本"), (6, "ÀÉ")]
    assert [t.decode() for t in terms_of(pa.array(texts).slice(3, 2))[0].to_pylist()] == ["É", "Àb", "x"]


def test_weights_of_large_counts():
    rng = random.Random(2)
    for most in (10**6, 10**12, 9 * 10**16):
        totals = [rng.randrange(1, most) for _ in range(200)]
        counts = [rng.randrange(t) for t in totals]
        assert weights(np.array(counts), np.array(totals)).tolist() == [1 + SCALE * (c + 1) // t for c, t in zip(counts, totals)]
    assert differ(np.array([1 + SCALE]), np.array([1])).tolist() == [SCALE**2]


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 16)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("wa", "wo", "É", "日") for b in "abcdefghijklmnopq"] + ["THE", "The", "x" * 300]
    sources = ["s1", "s2", "s3", "Ä", "", None]
    docs = [(rng.choice([i, None]), " ".join(rng.choices(words[: rng.choice([5, 40, len(words)])], k=rng.randrange(40))), rng.choice(["en", "en", "de", None]), rng.choice(sources), "x") for i in range(300)]
    docs += [(i, "common common", "en", "s1", "x") for i in range(500)]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    for limit, per_range in ((1_000_000, 1_000_000), (1_000_000, 20), (60, 10)):
        assert result(divergence(frame, limit=limit, per_range=per_range)) == plain(docs)
    assert result(divergence(frame, least=1, most=3)) == plain(docs, 1, 3)


def test_odd_rows(spark):
    docs = [(None, None, None, None, None), (1, "", "fr", "a", "x"), (1, "12 34 #", "fr", "b", "x"), (2, "twice twice", "fr", "c", "x")]
    docs += [(i, "long" * 100_000 + " " + "ab cd " * 50_000, "en", f"s{i % 2}", "x") for i in range(4)]
    docs += [(9, "tie tia tib", "de", "one", "x")] * 3 + [(9, "", "de", "two", "x")]
    assert result(divergence(spark.createDataFrame(docs, DOCS))) == plain(docs)


def test_many_segments_and_blocks(spark):
    """More leaves than a segment, a sweep and a block hold, in few ranges."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(2, 7))) for _ in range(60_000)]
    docs = [(i, " ".join(rng.choices(words, k=3_000)), "en", f"s{rng.randrange(3)}", "x") for i in range(150)]
    assert result(divergence(spark.createDataFrame(docs, DOCS).repartition(12), limit=30_000, per_range=300_000)) == plain(docs)


def test_no_rows(spark):
    assert not result(divergence(spark.createDataFrame([], DOCS)))
