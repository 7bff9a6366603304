"""The filter audit against every order applied in turn."""

import random
import re
from itertools import permutations

import pytest

from millrace.llm.filter_audit import COUNTS, audit, edges_of, steps_of, text_checks

DOCS, LABELS = "doc_id long, text string, lang string, mask int, subset string", "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def in_turn(docs, labels):
    good, toxic = ({i for i, *x in labels if x[j] == 1 and i is not None} for j in (0, 1))
    rows = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        failed = {k for k, v in fails(text).items() if v}
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in docs):
            failed.add("E")
        rows.append((doc_id, lang or "", failed))
    found = {}
    for part in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                stay = [r for r in left if f not in r[2]]
                failing = [r for r in own if f in r[2]]
                shapley[f] += len(gone)
                found[part, order, step] = [len(stay), len(gone), len(failing) - len(gone), sum(r[2] == {f} for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                left = stay
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return found


def result(df):
    assert df.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): [*r[3:]] for r in rows}
    assert len(found) == len(rows)
    return found


def test_lattice():
    assert len(edges_of(5)) == 80 and len(steps_of("ABCDE")) == 600
    # every order passes one edge of each size
    assert sum(w for s, _, w in edges_of(5) if s.bit_count() == 2) == 120


def test_against_every_order(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "日本語", " ", "SHOUT", "LOUD"]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words if rng.random() < 0.7 else words[:60], k=rng.choice([0, 20, 99, 100, 150])))
        text = text.upper() if rng.random() < 0.2 else text
        text = rng.choice(["#", "|", "a*b "]) + text if rng.random() < 0.3 else text
        docs.append((rng.randrange(90) if rng.random() < 0.95 else None, rng.choice(docs)[1] if docs and rng.random() < 0.3 else text, rng.choice(["en", "de", "", None]), i, "x"))
    labels = [(rng.randrange(100), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    assert result(audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))) == in_turn(docs, labels)


def test_odd_rows(spark):
    docs = [(None, None, None, None, None), (3, None, "en", 1, ""), (3, "", "en", 1, ""), (4, "", "en", 1, ""), (5, "\t\x0b\x0c\r\n ", "en", 1, "")]
    docs += [(6, "word\x85\xa0 " * 200_000, "en", 1, ""), (7, "word\x85\xa0 " * 200_000, "fr", 1, ""), (8, "A" * 1_000_000, "fr", 1, "")]
    assert result(audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))) == in_turn(docs, [])


def test_no_rows(spark):
    assert not result(audit(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)))


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "a", "en"), (3, "b#", "en")], "doc_id long, text string, lang string")
    found = result(audit(docs, spark.createDataFrame([], LABELS), {"x": text_checks()["D"]}, repeat="y"))
    assert found == {("en", "xy", 1): [2, 1, 0, 1, 0, 0, 2], ("en", "xy", 2): [1, 1, 0, 1, 0, 0, 2], ("en", "yx", 1): [2, 1, 0, 1, 0, 0, 2], ("en", "yx", 2): [1, 1, 0, 1, 0, 0, 2]}
    with pytest.raises(ValueError, match="letter"):
        audit(docs, docs, {"E": text_checks()["D"]})
