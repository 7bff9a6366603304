import numpy as np

from millrace.llm.decontaminate import clean, judge

DOCS, ITEMS = "doc_id long, text string, item string", "item_id long, text string, covered int"


def words(rng, n):
    return ["".join(rng.choice(list("aeionrst"), 5)) for _ in range(n)]


def run(spark, docs, items):
    d, b = spark.createDataFrame([(i, t, "c") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    rows = judge(d, b).collect()
    kept = clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in rows if not r.contaminated), key=str)
    return {(r.doc_id, r.item_id) for r in rows if r.contaminated}, len(rows)


QUESTION = "Tom has 3 apples and buys 12 more apples at the market for 40 cents each, then Tom walks 5 miles home. How much did Tom pay?"


def test_planted_leaks(spark):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(words(rng, 25)) + ".") for i in range(20)] + [(50, QUESTION)]
    filler = lambda: " ".join(words(rng, 60))
    docs = [(i, filler()) for i in range(40)]
    plant = {
        100: items[3][1],
        101: filler() + " " + items[4][1].upper() + " " + filler(),
        102: filler() + "\n" + items[5][1].replace(" ", "!!\n") + filler(),
        103: " ".join(items[6][1].split()[:22]),
        104: QUESTION.replace("Tom", "Ann").replace("3", "7").replace("12", "1,500").replace("5 miles", "9 km"),
        105: filler() + " " + QUESTION.lower(),
    }
    want = {(100, 3), (101, 4), (102, 5), (103, 6), (104, 50), (105, 50)}
    edited = items[7][1].split()
    edited[12] = "other words here"
    plant[106], want = " ".join(edited), want | {(106, 7)}
    not_leaks = {
        200: " ".join(items[8][1].split()[:15]),  # too little of it
        201: " ".join(reversed(items[9][1].split())),
        202: " ".join(w for w in items[10][1].split() for w in (w, "gap")),
        203: "1 2 3 4 5 6 7 8 9 10 11 12", 204: None, 205: "", 206: "... !!! ---",
    }
    found, n = run(spark, docs + list(plant.items()) + list(not_leaks.items()), items)
    assert found == want and n == len(docs) + len(plant) + len(not_leaks)


def test_slots_must_be_consistent(spark):
    item = "Tom gave Kim two of Tom red cards because Tom owed Kim and then Kim gave Tom back what Tom lent Kim once"
    names = iter("Ann Bob Cid Dan Eve Fay Gil Hal Ivy Jon".split() * 2)
    mixed_up = " ".join(next(names) if i and w in ("Tom", "Kim") else w for i, w in enumerate(item.split()))
    renamed = item.replace("Tom", "Zoe").replace("Kim", "Max")
    renamed = "Tom" + renamed[3:]
    found, _ = run(spark, [(1, "so " + mixed_up), (2, "so " + item), (3, "so Zoe" + renamed[3:])], [(1, "so " + item)])
    assert found == {(2, 1), (3, 1)}


def test_short_items_match_whole_documents_only(spark):
    found, _ = run(spark, [(1, "what is love"), (2, "tell me what is love now please"), (3, "What is love?")], [(9, "What is love"), (10, None), (11, "")])
    assert found == {(1, 9), (3, 9)}


def test_repeats_ties_nulls_and_empty_tables(spark):
    text = " ".join(words(np.random.default_rng(2), 30))
    found, n = run(spark, [(1, text), (1, text), (1, "something else entirely in this row"), (None, text)], [(5, text), (4, text), (None, text), (4, text)])
    assert found == {(1, 4), (None, 4)} and n == 4
    assert run(spark, [], [(1, text)]) == (set(), 0)
    assert run(spark, [(1, text)], []) == (set(), 1)


def test_very_long_text_and_common_passage(spark):
    rng = np.random.default_rng(3)
    item = " ".join(words(rng, 20))
    docs = [(i, f"{item} {i}") for i in range(300)] + [(1000, " ".join(words(rng, 60_000)) + " " + item), (1001, " ".join(words(rng, 60_000)))]
    found, _ = run(spark, docs, [(0, item)])
    assert found == {(i, 0) for i in range(300)} | {(1000, 0)}


def test_asides_and_longer_names(spark):
    """Whole items with asides in them, at distances that no band of a few words holds."""
    rng = np.random.default_rng(6)
    short, long = words(rng, 30), words(rng, 100)
    named = "so Tom gave Kim two red cards and then Kim sold Tom some blue cards while Tom and Kim sat there with Tom all day"
    grown = named.replace("Tom", "Ann Mary Lou Smith").replace("Kim", "Max van Dyk Berg")
    aside = lambda n: words(rng, n)
    docs = {
        1: short[:15] + aside(10) + short[15:],
        2: long[:25] + aside(4) + long[25:50] + aside(4) + long[50:75] + aside(4) + long[75:],
        3: aside(40) + short[:10] + aside(12) + short[10:20] + aside(12) + short[20:] + aside(40),
        4: grown.split(),
        5: short[15:] + aside(10) + short[:15],  # not in order
        6: short[:15] + aside(500) + short[15:],  # too far apart
    }
    found, _ = run(spark, [(d, " ".join(t)) for d, t in docs.items()], [(1, " ".join(short)), (2, " ".join(long)), (3, named)])
    assert found == {(1, 1), (2, 2), (3, 1), (4, 3)}


def brute_covered(doc, item, width=5):
    """Most words of the item that an ascending chain covers, of words in windows that both texts have: all pairs of
    places, no hashes, no joins."""
    d, i = doc.split(), item.split()
    cells = set()
    for p in range(len(d) - width + 1):
        for q in range(len(i) - width + 1):
            if d[p : p + width] == i[q : q + width]:
                cells |= {(p + k, q + k) for k in range(width)}
    best = {}
    for p, q in sorted(cells):
        best[p, q] = 1 + max((n for (a, b), n in best.items() if a < p and b < q), default=0)
    return max(best.values(), default=0)


def test_equals_brute_force(spark):
    """Items cut, spread by asides, out of order and repeated in parts, in texts of few words."""
    rng = np.random.default_rng(8)
    vocabulary = words(rng, 40)
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(8, 24))))) for i in range(12)]
    docs = []
    for d in range(160):
        own = items[int(rng.integers(12))][1].split()
        a, b = sorted(rng.integers(0, len(own) + 1, 2)) if rng.random() < 0.3 else (0, len(own))
        cut = int(rng.integers(0, len(own)))
        parts = [own[a:b], list(rng.choice(vocabulary, int(rng.integers(0, 6)))), own[cut:]] if rng.random() < 0.5 else [own[:cut], list(rng.choice(vocabulary, int(rng.integers(0, 4)))), own[cut:]]
        docs.append((d, " ".join([*rng.choice(vocabulary, int(rng.integers(0, 8))), *(w for p in parts for w in p)])))
    found, _ = run(spark, docs, items)
    flagged = {d for d, _ in found}
    # by the whole text, which none of these is longer than a span of the shortest item
    want = {d for d, t in docs if any(brute_covered(t, i) >= 0.8 * len(i.split()) - 1e-9 for _, i in items)}
    assert flagged == want and 20 < len(want) < 150
    for d, i in found:
        assert brute_covered(dict(docs)[d], dict(items)[i]) >= 0.8 * len(dict(items)[i].split())
